"""Conversation operators against plain rules, over all short message
sequences."""

import itertools

from docweave.operators import chat as CH


def _after_delete(msgs, question):
    """Rule by positions: in each run of equal hits the odd ones delete
    themselves and the next message."""
    hits = [r == "user" and c == question for r, c in msgs]
    gone = set()
    for i, hit in enumerate(hits):
        if hit and i not in gone:
            gone |= {i, i + 1}
    return [m for i, m in enumerate(msgs) if i not in gone]


def _found_pairs(msgs, query):
    """Rule by positions: among matching user and assistant messages, each
    assistant message right after a user message."""
    hits = [m for m in msgs if m[0] in ("user", "assistant") and query in m[1].lower()]
    return [(q[1], a[1]) for q, a in zip(hits, hits[1:]) if (q[0], a[0]) == ("user", "assistant")]


def _sessions():
    alphabet = [("user", "Q"), ("user", "x"), ("assistant", "Q a"), ("assistant", "b"), ("system", "q")]
    out = []
    for n in range(1, 6):
        for combo in itertools.product(range(len(alphabet)), repeat=n):
            out.append([alphabet[i] for i in combo])
    return out


def test_delete_pair_and_search_pairs_brute_force(spark):
    sessions = _sessions()
    rows = [(f"s{i}", t, r, c) for i, s in enumerate(sessions) for t, (r, c) in enumerate(s)]
    msgs = spark.createDataFrame(rows, "session_id string, turn long, role string, content string")
    req = spark.createDataFrame([(f"s{i}", "Q") for i in range(len(sessions))], "session_id string, question string")
    kept = {}
    for r in CH.delete_pair(msgs, req).collect():
        kept.setdefault(r.session_id, []).append((r.turn, r.role, r.content))
    found = {}
    for r in CH.search_pairs(msgs, "Q").collect():
        found.setdefault(r.session_id, []).append((r.turn, r.question, r.answer))
    for i, s in enumerate(sessions):
        got = [(ro, c) for _, ro, c in sorted(kept.get(f"s{i}", []))]
        assert got == _after_delete(s, "Q"), s
        pairs = [(q, a) for _, q, a in sorted(found.get(f"s{i}", []))]
        assert pairs == _found_pairs(s, "q"), s


def test_append_and_titles(spark):
    msgs = spark.createDataFrame([("a", 0, "user", "hello there"), ("a", 1, "assistant", "hi")],
                                 "session_id string, turn long, role string, content string")
    import datetime as dt
    req = spark.createDataFrame([("a", "q1", "r1", dt.datetime(2025, 3, 7, 16, 50, 51), 1),
                                 (None, "q2", "r2", dt.datetime(2025, 3, 7, 16, 50, 51), 2)],
                                "session_id string, question string, answer string, ts timestamp, seq long")
    out = sorted(CH.append_messages(msgs, req).collect())
    assert ("a", 2, "user", "q1") in [tuple(r) for r in out]
    assert ("chat_session_20250307_165051_2", 1, "assistant", "r2") in [tuple(r) for r in out]
    t = {r.session_id: r.title for r in CH.conversation_title(msgs).collect()}
    assert t == {"a": "hello there"}


def test_state_machines_across_many_buckets(spark, monkeypatch):
    """Same brute force with 3-turn buckets: every session spans several
    buckets, so bucket offsets and previous-row joins are exercised."""
    import random

    import docweave.plans.skew as SK
    monkeypatch.setattr(SK, "BUCKET", 3)
    random.seed(9)
    alphabet = [("user", "Q"), ("user", "x"), ("assistant", "Q a"), ("assistant", "b"), ("system", "q")]
    sessions = [[random.choice(alphabet) for _ in range(random.randint(1, 14))] for _ in range(400)]
    rows = [(f"s{i}", 2 * t + 1, r, c) for i, s in enumerate(sessions) for t, (r, c) in enumerate(s)]
    msgs = spark.createDataFrame(rows, "session_id string, turn long, role string, content string")
    req = spark.createDataFrame([(f"s{i}", "Q") for i in range(len(sessions))], "session_id string, question string")
    kept, found = {}, {}
    for r in CH.delete_pair(msgs, req).collect():
        kept.setdefault(r.session_id, []).append((r.turn, r.role, r.content))
    for r in CH.search_pairs(msgs, "Q").collect():
        found.setdefault(r.session_id, []).append((r.turn, r.question, r.answer))
    for i, s in enumerate(sessions):
        assert [(ro, c) for _, ro, c in sorted(kept.get(f"s{i}", []))] == _after_delete(s, "Q")
        assert [(q, a) for _, q, a in sorted(found.get(f"s{i}", []))] == _found_pairs(s, "q")


def test_delete_pair_with_several_requests(spark):
    """Randomised: 0 to 4 requests per session, repeats included, in order."""
    import random

    rng = random.Random(4)
    alphabet = [("user", "Q"), ("user", "R"), ("user", "x"), ("assistant", "a"), ("assistant", "Q")]
    sessions = [[rng.choice(alphabet) for _ in range(rng.randint(0, 9))] for _ in range(150)]
    requests = [[rng.choice(["Q", "R", "x", "nothing"]) for _ in range(rng.randint(0, 4))] for _ in sessions]
    msgs = spark.createDataFrame([(f"s{i}", t, r, c) for i, s in enumerate(sessions) for t, (r, c) in enumerate(s)],
                                 "session_id string, turn long, role string, content string")
    req = spark.createDataFrame([(f"s{i}", q, k) for i, qs in enumerate(requests) for k, q in enumerate(qs)],
                                "session_id string, question string, seq long")
    kept = {}
    for r in CH.delete_pair(msgs, req, "seq").collect():
        kept.setdefault(r.session_id, []).append((r.turn, r.role, r.content))
    for i, s in enumerate(sessions):
        for q in dict.fromkeys(requests[i]):
            s = _after_delete(s, q)
        assert [(ro, c) for _, ro, c in sorted(kept.get(f"s{i}", []))] == s


def test_new_sessions_of_one_second_stay_apart(spark):
    import datetime as dt

    msgs = spark.createDataFrame([("chat_session_20250307_165051_7", 0, "user", "old")],
                                 "session_id string, turn long, role string, content string")
    at = dt.datetime(2025, 3, 7, 16, 50, 51)
    req = spark.createDataFrame([(None, "q1", "r1", at, 1), (None, "q2", "r2", at, 2), ("gone", "q7", "r7", at, 7)],
                                "session_id string, question string, answer string, ts timestamp, seq long")
    out = {(r.session_id, r.turn, r.content) for r in CH.append_messages(msgs, req).collect()}
    base = "chat_session_20250307_165051"
    assert {(f"{base}_1", 0, "q1"), (f"{base}_2", 0, "q2"), (f"{base}_7", 1, "q7")} <= out and len(out) == 7
