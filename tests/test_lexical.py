"""Lexical operators against brute force / pure-Python references."""

import random

from pyspark.sql import functions as F

from docweave.operators import lexical as LX


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def _ratio(a, b):
    m = max(len(a), len(b))
    return 1.0 if m == 0 else 1 - _lev(a, b) / m


def test_fuzzy_best_match_brute_force(spark):
    random.seed(11)
    words = ["alpha", "beta", "gamma", "delta", "ab", "a", ""]
    strs = []
    for _ in range(120):
        s = " ".join(random.choice(words) for _ in range(random.randint(0, 4)))
        if random.random() < 0.3 and s:
            i = random.randrange(len(s))
            s = s[:i] + random.choice("xyz") + s[i + 1:]
        strs.append(s)
    strs += ["same"] * 15  # a hot group of copies
    df = spark.createDataFrame(list(enumerate(strs)), "id long, s string")
    got = {r.id: (r.match_id, r.ratio) for r in LX.fuzzy_best_match(
        df, df, l_id="id", l_text="s", r_id="id", r_text="s", threshold=0.8, exclude_self=True).collect()}
    for i, a in enumerate(strs):
        best = None
        for j, b in enumerate(strs):
            if i == j:
                continue
            r = _ratio(a, b)
            if r >= 0.8 and (best is None or r > best[1] or (r == best[1] and j < best[0])):
                best = (j, r)
        if best is None:
            assert got[i][0] is None, (a, got[i])
        else:
            assert got[i][0] == best[0] and abs(got[i][1] - best[1]) < 1e-12, (a, got[i], best)


def test_bleu_matches_reference(spark):
    pairs = [("the cat sat on the mat", "the cat sat on the mat"),
             ("the cat sat on the mat", "the cat is on the mat today"),
             ("a b c d e f g", "a b c d x f g a b"),
             ("", "x"), ("x", ""), ("one two", "one two")]
    df = spark.createDataFrame([(i, r, c) for i, (r, c) in enumerate(pairs)], "k long, r string, c string")
    got = {x.k: x.bleu for x in LX.bleu(df, "k", "r", "c").collect()}
    for i, (r, c) in enumerate(pairs):
        assert abs(got[i] - LX.bleu_reference(r, c)) < 1e-9


def test_rouge_l_lcs(spark):
    def lcs_dp(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]
    random.seed(5)
    for _ in range(200):
        a = [random.choice("abcd") for _ in range(random.randint(0, 12))]
        b = [random.choice("abcd") for _ in range(random.randint(0, 12))]
        assert LX.lcs_length(a, b) == lcs_dp(a, b)
    df = spark.createDataFrame([("The cat sat.", "the cat sat"), ("", "x")], "r string, c string")
    vals = [x[0] for x in df.select(LX.rouge_l(F.col("r"), F.col("c"))).collect()]
    assert vals == [1.0, 0.0]


def test_sentence_overlap_topk(spark):
    df = spark.createDataFrame([("Cats eat fish. Dogs eat meat. Birds fly high. Fish swim.", "what do cats eat")],
                               "t string, q string")
    out = df.select(LX.sentence_overlap_topk(F.col("t"), F.col("q"), 2)).first()[0]
    assert out.split("\n") == ["Cats eat fish.", "Dogs eat meat."]


def test_bleu_udf_equals_relational(spark, sf):
    from docweave.registry.lexical import eval_pairs
    p = eval_pairs(spark, sf)
    a = {r.doc_id: round(r.bleu, 9) for r in LX.bleu(p, "doc_id", "reference", "candidate").collect()}
    b = {r.doc_id: round(r.bleu, 9) for r in LX.bleu_relational(p, "doc_id", "reference", "candidate").collect()}
    assert a == b


def test_fuzzy_settled_strings_are_not_searched_for(spark, monkeypatch):
    kept = []

    def held(df):
        kept.append(df.localCheckpoint())
        return kept[-1]

    monkeypatch.setattr(LX, "reliable_checkpoint", held)
    rows = [(1, "red apple pie"), (2, "red apple pie"), (3, "red apple pies"), (4, None), (5, ""), (6, "green plum"), (6, "green plum")]
    df = spark.createDataFrame(rows, "id long, s string")
    got = {(r["id"], r["match_id"], r["ratio"]) for r in LX.fuzzy_best_match(df, df, l_id="id", l_text="s", r_id="id", r_text="s").collect()}
    assert got == {(1, 1, 1.0), (2, 1, 1.0), (3, 3, 1.0), (4, None, None), (5, 5, 1.0), (6, 6, 1.0)}
    assert kept[2].count() == 0  # every string has its like
    got = {(r["id"], r["match_id"], r["ratio"] and round(r["ratio"], 6)) for r in LX.fuzzy_best_match(
        df, df, l_id="id", l_text="s", r_id="id", r_text="s", exclude_self=True).collect()}
    assert got == {(1, 2, 1.0), (2, 1, 1.0), (3, 1, round(1 - 1 / 14, 6)), (4, None, None), (5, None, None), (6, None, None)}
    assert {r["ls"] for r in kept[5].collect()} == {"red apple pies", "", "green plum"}
