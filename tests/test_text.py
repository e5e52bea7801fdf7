"""Scalar text functions against Python's own regex semantics on edge rows."""

import re

import pytest
from pyspark.sql import functions as F

from docweave.functions import text as tx

EDGE = ["", "   ", " x ", "café crème", "the the cat", "one two one two three",
        "a b c d e f a b c d e f", "3.14", "Hello , world !x", "visit ahttp://x.org now",
        "Did you know this is a test sentence? Yes it is a fine sentence here.",
        "Back Forward Acme Help page", "Wait... please accept our apologies."]


def _run(spark, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EDGE)], "i int, t string")
    return [r.o for r in df.select(fn(F.col("t")).alias("o")).orderBy("i").collect()]


def test_normalize_whitespace(spark):
    assert _run(spark, tx.normalize_whitespace) == [re.sub(r"\s+", " ", t).strip() for t in EDGE]


def test_collapse_repeated_phrases_matches_python(spark):
    pat = re.compile(r"\b((?:\w+\s+){1,5}?\w+)\s+\1\b", re.IGNORECASE)
    assert _run(spark, tx.collapse_repeated_phrases) == [pat.sub(r"\1", t) for t in EDGE]


def test_fix_punctuation_spacing(spark):
    def ref(t):
        t = re.sub(r"\s+([.,!?])", r"\1", t)
        return re.sub(r"([.,!?])(?=\w)", r"\1 ", t)
    assert _run(spark, tx.fix_punctuation_spacing) == [ref(t) for t in EDGE]


def test_drop_filler_sentences(spark):
    def ref(t):
        sents = [s.strip() for s in re.split(r"(?<=[.?!])\s+", t)]
        return "\n".join(s for s in sents if len(s.split()) >= 5 and not s.lower().startswith("did you know"))
    assert _run(spark, tx.drop_filler_sentences) == [ref(t) for t in EDGE]


def test_strip_fillers_and_ellipsis(spark):
    out = _run(spark, lambda c: tx.collapse_ellipsis(tx.strip_fillers(c, "Acme", "8.09")))
    assert out[11].strip() == "page"
    assert out[12] == "Wait. "
    plain = _run(spark, tx.strip_fillers)  # without a product only generic phrases go
    assert plain[11].strip() == "Acme Help page"
    df = spark.createDataFrame([("Acme Help 8.09 % intro. End of search results.",)], "t string")
    assert df.select(tx.strip_fillers(F.col("t"), "Acme", "8.09")).first()[0].strip() == "intro."


def test_truncate_title(spark):
    df = spark.createDataFrame([("one two three four five six seven eight nine",), ("short title",)], "t string")
    out = [r.o for r in df.select(tx.truncate_title(F.col("t")).alias("o")).collect()]
    assert out == ["one two three four five six seven eight...", "short title"]


@pytest.mark.parametrize("s,expected", [("**bold** and\nnext", "<b>bold</b> and<br>next")])
def test_render_answer(spark, s, expected):
    df = spark.createDataFrame([(s,)], "t string")
    assert df.select(tx.render_answer(F.col("t"))).first()[0] == expected


def test_deaccent_and_topic_tokens(spark):
    import unicodedata

    def ref_deacc(s):
        return unicodedata.normalize("NFC", "".join(
            c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)))
    words = ["Café crème", "Über Straße", "niño ÅÇÈ", "élève à l'école", "x1 ab_cd"]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    got = [r[0] for r in df.select(tx.deaccent(F.col("t"))).collect()]
    assert got == [ref_deacc(w) for w in words]
    toks = [r[0] for r in df.select(tx.topic_tokens(F.col("t"))).collect()]
    assert toks[0] == ["cafe", "creme"] and toks[2] == ["nino", "ace"] and toks[4] == ["ab", "cd"]
