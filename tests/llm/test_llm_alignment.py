"""Token alignment against a plain version: groups, links, corpus counts."""

import hashlib
import random
from collections import Counter, defaultdict

import sentencepiece
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docweave.llm import token_alignment as ta
from docweave.llm.registry import BYTE_TOKENIZER, QUERIES, TOKENIZER
from docweave.session import table

FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@given(st.sets(st.integers(1, 120), max_size=80), st.sets(st.integers(1, 120), max_size=80), st.booleans())
def test_groups_end_at_common_ends(x, y, alike):
    a, b = sorted(x | {121}), sorted((x if alike else y) | {121})
    cut_a, cut_b = ta.group_ends(ta.align(a, b))
    assert [a[k - 1] for k in cut_a] == sorted(set(a) & set(b)) == [b[k - 1] for k in cut_b]


def plain(texts):
    """Per text the values of ``FIELDS``, token by token."""
    fast = Tokenizer.from_file(BYTE_TOKENIZER)
    fast.encode_special_tokens = True
    slow = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    to_byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
    made, count = [], Counter()
    for t in texts:
        if not t:
            made.append(None)
            continue
        e = fast.encode(" " + t, add_special_tokens=False)
        a = [(i, bytes(to_byte[c] for c in p)) for i, p in zip(e.ids, e.tokens)]
        b = [(i, bytes([int(p[3:5], 16)]) if slow.is_byte(i) else p.replace("▁", " ").encode())
             for i in slow.encode(t) for p in [slow.id_to_piece(i)]]
        if b"".join(x for _, x in a) != (" " + t).encode() or b"".join(x for _, x in b) != (" " + t).encode():
            made.append(None)
            continue
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((at, at + len(x), i))
                at += len(x)
            spans.append(out)
        ends = sorted({x[1] for x in spans[0]} & {x[1] for x in spans[1]})
        start, groups, links = 0, [], []
        by_start = [sorted(s) for s in spans]
        at = [0, 0]
        for end in ends:
            group = []
            for side in (0, 1):
                mine = []
                while at[side] < len(by_start[side]) and by_start[side][at[side]][1] <= end:
                    mine.append(by_start[side][at[side]])
                    at[side] += 1
                group.append(mine)
            groups.append(",".join(str(x[2]) for x in group[0]) + "|" + ",".join(str(x[2]) for x in group[1]))
            links += [(p[2], q[2]) for p in group[0] for q in group[1] if p[0] < q[1] and q[0] < p[1]]
            start = end
        count.update(links)
        made.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if m is None else
            (m[0], m[1], m[2], len(m[3]), sum(count[x] == most[x[1]] for x in m[3]), sum(count[x] for x in m[3]), m[4]) for m in made]


def test_query_equals_the_plain_version(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    want = {i: x for (i, _), x in zip(rows, plain([t for _, t in rows]))}
    got = {r["doc_id"]: tuple(r[f] for f in FIELDS) for r in QUERIES["op13_token_alignment"](spark, sf).collect()}
    assert got == want and any(x[2] < min(x[:2]) for x in want.values())


def _messy():
    rng = random.Random(4)
    texts = [None, "", " ", "  two  blanks\n\n\ttab ", "<|endoftext|> and </s> <unk>", "▁ own mark", "café naïve 日本語 \U0001f642\U0001f642",
             "a\x00b", "x" * 3000, "don't we'll 12345 $%^", "\u0085 　blank"]
    texts += [" ".join(rng.choice(["the", "Zebra", "quixotry", "été", "4.2"]) for _ in range(n)) for n in (5, 50, 3000)]
    return [(k if k % 4 else None, t) for k, t in enumerate(texts + texts[5:9])]


def test_messy_rows(spark, monkeypatch):
    rows = _messy()
    docs = spark.createDataFrame([(*r, "b", 1, "d") for r in rows], "doc_id long, text string, block string, n_a long, `a.b` string")
    files = ta.read_file(BYTE_TOKENIZER), ta.read_file(TOKENIZER)
    want = Counter((i, *x) for (i, _), x in zip(rows, plain([t for _, t in rows])))
    for parts in (1, 3):
        got = ta.link_statistics(docs.repartition(parts), *files)
        assert Counter(tuple(r) for r in got.select("row.doc_id", *FIELDS).collect()) == want
        assert got.select("row.*").columns == ["doc_id", "block", "n_a", "a.b"]
    assert ta.link_statistics(docs.limit(0), *files).count() == 0
    only = ta.link_statistics(docs.filter("text is null or text = ''"), *files)
    assert only.select("n_links", "groups_sha256").distinct().collect() == [(0, "")]


def test_blocks_of_one_document_give_the_same_counts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").repartition(16).limit(60)
    files = ta.read_file(BYTE_TOKENIZER), ta.read_file(TOKENIZER)
    rows = [tuple(r) for r in docs.collect()]
    fixed = spark.createDataFrame(rows, docs.schema)
    want = {i: x for (i, _), x in zip(rows, plain([t for _, t in rows]))}
    for parts in (1, 30):
        got = ta.link_statistics(fixed.repartition(parts), *files)
        assert {r["doc_id"]: tuple(r[f] for f in FIELDS) for r in got.select("row.doc_id", *FIELDS).collect()} == want
