"""Chunk lengths in byte-pair tokens, against a plain segmenter."""

import base64

import regex

from docweave.functions import bpe
from docweave.operators import chunk as C
from docweave.registry import all_queries
from docweave.registry.retrieval import VOCABULARY
from docweave.session import table

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}


def plain(text):
    """Tokens by merging, in each word, the neighbours of the lowest rank."""
    out = []
    for word in regex.findall(bpe.WORDS, text):
        parts = [bytes([b]) for b in word.encode()]
        while len(parts) > 1:
            ranks = [RANKS.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
            k = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[k] == 1 << 30:
                break
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        out += parts
    return out


def test_counts_equal_a_plain_segmenter(spark, sf):
    count = bpe.TokenCounter(bpe.read_vocabulary(VOCABULARY))
    texts = [r["text"][:3000] for r in table(spark, sf, "documents").limit(30).collect()]
    for t in [*texts, "", " ", "don't we'll  12,345\n\n\tnaïve 日本 🙂 \x00", "aaaa" * 50]:
        assert count(t) == len(plain(t))
        assert b"".join(plain(t)) == t.encode()


def test_chunks_hold_at_most_the_size(spark, sf):
    count = bpe.TokenCounter(bpe.read_vocabulary(VOCABULARY))
    docs = table(spark, sf, "documents").select("doc_id", "text").limit(60)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = C.chunk_recursive_tokens(docs, ["doc_id"], "text", 120, 20, VOCABULARY).collect()
    for r in rows:
        assert text[r["doc_id"]][r["start"]:r["end"]] == r["chunk"] and len(plain(r["chunk"])) <= 120 + 1
    want = {(i, k, *s) for i, t in text.items() for k, s in enumerate(C.recursive_spans(t, 120, 20, length=lambda x: len(plain(x)) if len(x) < 40 else count(x)))}
    assert {(r["doc_id"], r["chunk_no"], r["start"], r["end"]) for r in rows} == want
    packed = C.chunk_sentences(docs, ["doc_id"], "text", 120, 30, VOCABULARY).collect()
    assert all(text[r["doc_id"]][r["start"]:r["end"]] == r["chunk"] for r in packed)


def test_query_and_messy_rows(spark, sf):
    assert all_queries()["chunk_recursive_tokens"](spark, sf).filter("end > start").count() > 200
    odd = spark.createDataFrame([(1, None), (2, ""), (None, " \n "), (4, "x" * 9000), (5, "a b")], "doc_id long, text string")
    got = C.chunk_recursive_tokens(odd, ["doc_id"], "text", 50, 5, VOCABULARY).collect()
    assert {r["doc_id"] for r in got} == {4, 5}
    assert C.chunk_recursive_tokens(odd.limit(0), ["doc_id"], "text", 50, 5, VOCABULARY).count() == 0
