"""Work of the sentence model and the sentence chunker on each word."""

import random
from collections import Counter

from docweave.operators import chunk as C
from docweave.operators import sentences as S


def test_words_are_parsed_once_each(monkeypatch):
    calls: Counter = Counter()
    plain = S.parsed
    monkeypatch.setattr(S, "parsed", lambda word: calls.update([word]) or plain(word))
    found = S.Counts()
    for _ in range(500):
        found.add("The house of Mr. Brown is old. It stands.")
    got = found.rows()
    assert max(calls.values()) == 1
    assert got["w", "house", "", ""] == 500 and got["s", "old", "", ""] == 500 and got["m", "house", "", "L"] == 500
    assert got["p", "mr", "brown", "U"] == 500 and got["p", "old", "it", "U"] == 500


def test_counts_and_stops_equal_a_plain_version():
    rng = random.Random(4)
    letters = list("aB1.?!\"'([{<«“¿)]}>»”,;: \t\n .. .")
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(25)))
        want: Counter = Counter()
        stops, before, at = [], None, 0
        for word in text.split():
            at = text.index(word, at)
            kind, case, stop, end = S.parsed(word)
            want["s" if stop else "w", kind, "", ""] += 1
            if before and before[1]:
                want["p", before[0], kind, case] += 1
                stops.append((before[0], at))
            elif before and not before[2]:
                want["m", kind, "", case] += 1
            before, at = (kind, stop, end), at + len(word)
        found = S.Counts()
        found.add(text)
        assert found.rows() == want, repr(text)
        assert [(S.parsed(m[1])[0], m.end()) for m in S._STOP.finditer(text) if S.parsed(m[1])[2]] == stops, repr(text)


def test_sentences_are_measured_once():
    seen: Counter = Counter()

    def length(part):
        seen[part] += 1
        return len(part)

    text = "One two three. Four five six seven. " + "w" * 30 + " " + "v" * 30 + ". End here."
    spans = C.sentence_spans(text, 40, 10, length)
    assert [text[a:b] for a, b in spans][0].startswith("One two three.") and spans[-1][1] == len(text)
    assert max(seen.values()) == 1, seen
