"""Learnt sentence boundaries: hand-marked text per language, counts and
scores against a plain version, chunks that keep abbreviations whole."""

import math
import random
from collections import Counter

import pytest

from docweave.operators import chunk as C
from docweave.operators import sentences as S
from docweave.registry import all_queries
from docweave.session import table

# ``|`` marks where a sentence ends.
MARKED = {
    "en": "Dr. Miller met Mr. Brown at noon.|The talk by J. Smith was long.|It was about oil, gas, etc. and lasted an hour!|Who paid?|Nobody knew.",
    "de": "Herr Dr. Vogel kam um drei.|Die Firma kauft z.B. Holz und Stahl.|Das kostet ca. zehn Mark.|Wer zahlt?|Niemand weiss es.",
    "fr": "Le film de M. Durand est long.|La ville de St. Malo est belle.|Qui paie?|Personne ne sait.|Il coûte env. dix francs.",
    "es": "El Sr. Gomez vive lejos.|La casa es grande.|Hay pan, vino, etc. en la mesa.|Quien paga?|Nadie lo sabe.",
}


def _corpus():
    """The marked sentences among many of the same make."""
    rng = random.Random(2)
    nouns = ["house", "river", "table", "letter", "garden", "window", "Holz", "ville", "casa", "mesa", "pan", "film"]
    short = ["Dr.", "Mr.", "etc.", "z.B.", "ca.", "M.", "St.", "env.", "Sr."]
    names = ["Miller", "Brown", "Vogel", "Durand", "Malo", "Gomez"]
    starts = ["The", "It", "Who", "Nobody", "Die", "Das", "Niemand", "La", "Le", "Il", "Hay", "Nadie", "Quien", "Qui", "Personne"]
    lines = []
    for _ in range(1500):
        a, b = rng.choice(nouns), rng.choice(nouns)
        start = rng.choice(starts)
        lines.append(rng.choice([f"{start} {a} and {start.lower()} {b} are here.", f"{start} {rng.choice(short)} {rng.choice(names)} saw a {a} and a {b}.",
                                 f"{start} {a}, {b}, {rng.choice(short)} and more of {start.lower()} kind."]))
    texts = [" ".join(lines[k:k + 10]) for k in range(0, len(lines), 10)]
    return texts + [m.replace("|", " ") for m in MARKED.values()]


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame(list(enumerate(_corpus())), "doc_id long, text string").repartition(5)
    return S.joined_pairs(S.corpus_counts(docs, "text")).cache()


@pytest.mark.parametrize("lang", sorted(MARKED))
def test_marked_text(spark, model, lang):
    df = spark.createDataFrame([(1, MARKED[lang].replace("|", " "))], "doc_id long, text string")
    got = [r["sentence"] for r in S.split_learnt(df, model, ["doc_id"]).orderBy("sentence_no").collect()]
    assert got == MARKED[lang].split("|")


def test_counts_and_scores_equal_a_plain_version(spark):
    texts = _corpus()[:60] + [None, "", " . ", "3. 4.5 A. b.c. ... ?!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    counts = S.corpus_counts(docs, "text")
    want: Counter = Counter()
    for t in texts:
        toks = [S.parsed(x) for x in (t or "").split()]
        for k, (kind, case, stop, _) in enumerate(toks):
            want["s" if stop else "w", kind, "", ""] += 1
            if k and toks[k - 1][2]:
                want["p", toks[k - 1][0], kind, case] += 1
            elif k and not toks[k - 1][3]:
                want["m", kind, "", case] += 1
    assert {tuple(r)[:4]: r["n"] for r in counts.collect()} == want
    s, w = Counter(), Counter()
    for (kind, t, _, _), n in want.items():
        if t and kind in "sw":
            (s if kind == "s" else w)[t] += n
    p = sum(s.values()) / (sum(s.values()) + sum(w.values()))
    score = {}
    for t, n in s.items():
        if any(c.isalpha() for c in t) and not (len(t) == 1 and t.isalpha()):
            ll = -2 * (n * math.log(p) + w[t] * math.log(1 - p) - n * math.log(0.99) - w[t] * math.log(0.01))
            letters = len(t) - t.count(".")
            v = ll * math.exp(-letters) * (t.count(".") + 1) * letters ** -w[t]
            if v >= 0.3:
                score[t] = v
    got = {r["type"]: r["score"] for r in S.abbreviations(counts).collect()}
    assert got.keys() == score.keys() and all(got[t] == pytest.approx(score[t]) for t in got) and "mr" in got


def test_chunks_keep_abbreviations_whole(spark, model):
    text = " ".join(m.replace("|", " ") for m in MARKED.values()) * 3
    df = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "", "z"), (1, text, "x")], "doc_id long, text string, inner string")
    rows = C.chunk_sentences(df, ["doc_id", "inner"], "text", 40, 10, model=model).collect()
    assert rows and all(text[r["start"]:r["end"]] == r["chunk"] for r in rows) and {r["inner"] for r in rows} == {"x"}
    assert not any(r["chunk"].endswith((" Dr.", " Mr.", " Sr.", " St.")) for r in rows)
    assert C.chunk_sentences(df.limit(0), ["doc_id"], "text", model=model).count() == 0


def test_queries(spark, sf):
    q = all_queries()
    text = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    rows = q["sentence_split"](spark, sf).collect()
    assert rows and all(r["sentence"] in text[r["doc_id"]] and len(r["sentence"].split()) >= 5 for r in rows)
    assert q["abbreviations"](spark, sf).filter("score < 0.3").count() == 0
