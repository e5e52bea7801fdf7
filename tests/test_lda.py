"""LDA against a plain version, and the graph of its top words."""

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.functions.text import STOP_WORDS
from docweave.operators import graph as G
from docweave.operators import lda
from docweave.operators import topics as TP
from docweave.registry import all_queries


def test_digamma():
    gamma = 0.5772156649015329
    assert lda.digamma(np.array([1.0, 2.0, 0.5])) == pytest.approx([-gamma, 1 - gamma, -gamma - 2 * math.log(2)], abs=1e-9)
    x = np.linspace(0.01, 40, 200)
    assert lda.digamma(x + 1) == pytest.approx(lda.digamma(x) + 1 / x, rel=1e-9)


def _tokens(t):
    flat = "".join(c for c in unicodedata.normalize("NFD", (t or "").lower()) if not unicodedata.combining(c))
    return [w for w in re.findall(r"[^\W\d_]+", flat) if 2 <= len(w) <= 15 and w not in STOP_WORDS]


def plain(texts, start, k, passes):
    """Topic-term parameters by a loop over documents; ``start`` by term."""
    docs = [Counter(_tokens(t)) for t in texts]
    terms = sorted(start)
    lam = np.array([start[t] for t in terms])
    at = {t: i for i, t in enumerate(terms)}
    for _ in range(passes):
        w = np.exp(lda.digamma(lam) - lda.digamma(lam.sum(axis=0)))
        s = np.zeros_like(lam)
        for d in docs:
            if not d:
                continue
            ids, n = np.array([at[t] for t in d]), np.array(list(d.values()), float)
            gamma = np.full(k, 1 / k + n.sum() / k)
            for _ in range(lda.INNER):
                share = np.exp(lda.digamma(gamma) - lda.digamma(gamma.sum()))
                phi = w[ids] * share
                phi /= phi.sum(axis=1, keepdims=True)
                before, gamma = gamma, 1 / k + (phi * n[:, None]).sum(axis=0)
                if np.abs(gamma - before).mean() < lda.CLOSE:
                    break
            share = np.exp(lda.digamma(gamma) - lda.digamma(gamma.sum()))
            phi = w[ids] * share
            s[ids] += n[:, None] * phi / phi.sum(axis=1, keepdims=True)
        lam = s + 1 / k
    return dict(zip(terms, lam))


def _texts():
    rng = np.random.default_rng(3)
    themes = [["apple", "pear", "plum", "cherry", "été"], ["engine", "wheel", "brake", "gear"], ["violin", "cello", "flute", "drum", "harp"]]
    out = [" ".join(rng.choice(themes[i % 3], 30)) + " the table" for i in range(45)]
    return out + [None, "", "1 2 3", "the of and", "apple " * 4000, out[0], out[0]]


def test_equals_the_plain_version(spark, monkeypatch):
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    terms = sorted({t for x in texts for t in _tokens(x)})
    words = spark.createDataFrame([(t,) for t in terms], "term string")
    start = {r["term"]: r["lam"] for r in words.select("term", F.array(*[lda.start_value(F.col("term"), t, 42) for t in range(3)]).alias("lam")).collect()}
    want = plain(texts, start, 3, 6)
    for block in (512, 7):
        monkeypatch.setattr(lda, "BLOCK_DOCS", block)
        got = {r["term"]: r["lam"] for r in lda.fit(df, "text", "doc_id", 3, 6).collect()}
        assert got.keys() == want.keys()
        assert all(got[t] == pytest.approx(want[t], rel=1e-6) for t in want)


def test_themes_are_found_and_become_a_graph(spark):
    df = spark.createDataFrame(list(enumerate(_texts())), "doc_id long, text string")
    words = TP.lda_topics(df, "text", 3, 10, 42, 4)
    rows = [tuple(r) for r in words.orderBy("topic", "rank").collect()]
    assert [r[:2] for r in rows] == [(t, k) for t in range(3) for k in range(1, 5)]
    assert all(a[3] >= b[3] for a, b in zip(rows, rows[1:]) if a[0] == b[0])
    pairs = words.select(F.concat(F.lit("Topic_"), F.col("topic").cast("string")).alias("topic"), F.col("term").alias("keyword"))
    nodes, edges = G.topic_keyword_edges(pairs)
    assert {(r["dst"], r["src"]) for r in edges.collect()} == {(f"Topic_{t}", w) for t, _, w, _ in rows}
    lines = {r["line"] for r in G.match_pattern(nodes, edges, "Keyword", "RELATED_TO", "Topic").collect()}
    assert lines == {f"{w} -[RELATED_TO]-> Topic_{t}" for t, _, w, _ in rows}
    assert TP.lda_topics(df.limit(0), "text").count() == 0


def test_registered_edges_are_the_top_words(spark, sf):
    q = all_queries()
    want = {(f"Topic_{r['topic']}", r["term"]) for r in q["lda_topics"](spark, sf).collect()}
    assert len(want) == 50
    assert {(r["dst"], r["src"]) for r in q["topic_keyword_edges"](spark, sf).collect()} == want
    assert {r["line"] for r in q["match_pattern"](spark, sf).collect()} == {f"{w} -[RELATED_TO]-> {t}" for t, w in want}
    text = {r["topic"]: r["text"] for r in q["format_triples"](spark, sf).collect()}
    assert {t: sorted(x.split("\n")) for t, x in text.items()} == {
        t: sorted(f"{w} -[RELATED_TO]-> {t}" for u, w in want if u == t) for t, _ in want}
