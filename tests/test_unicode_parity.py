"""Property tests: Spark's regex columns agree with Python's Unicode regex
semantics on random strings (accents, U+00A0, em space, tabs, newlines)."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.functions import text as tx

ALPHABET = "abcdeABCDEéèüßÉ019 \t\n\xa0 .,!?'-"
texts = st.lists(st.text(alphabet=ALPHABET, max_size=40), min_size=20, max_size=40)


def _spark(spark, strings, fn):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "i int, t string")
    return [r.o for r in df.select("i", fn(F.col("t")).alias("o")).orderBy("i").collect()]


@settings(max_examples=6, deadline=None)
@given(texts)
def test_whitespace_and_tokens(spark, strings):
    assert _spark(spark, strings, tx.normalize_whitespace) == [re.sub(r"\s+", " ", s).strip() for s in strings]
    assert _spark(spark, strings, tx.ustrip) == [s.strip() for s in strings]
    toks = _spark(spark, strings, lambda c: F.array_join(tx.tokens(c), "|"))
    assert toks == ["|".join(re.findall(r"\w+", s.lower())) for s in strings]


@settings(max_examples=6, deadline=None)
@given(texts)
def test_punctuation_and_sentences(spark, strings):
    def fix(s):
        s = re.sub(r"\s+([.,!?])", r"\1", s)
        return re.sub(r"([.,!?])(?=\w)", r"\1 ", s)
    assert _spark(spark, strings, tx.fix_punctuation_spacing) == [fix(s) for s in strings]
    got = _spark(spark, strings, lambda c: F.array_join(tx.split_sentences(c), "\u0001"))
    assert got == ["\u0001".join(re.split(r"(?<=[.?!])\s+", s)) for s in strings]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="ab Éé\xa0", max_size=30), min_size=20, max_size=40))
def test_repeated_phrases(spark, strings):
    pat = re.compile(r"\b((?:\w+\s+){1,5}?\w+)\s+\1\b", re.IGNORECASE)
    assert _spark(spark, strings, tx.collapse_repeated_phrases) == [pat.sub(r"\1", s) for s in strings]
