"""Spelling variants: the index against all pairs, the query against a plain
version, splitting of large keys, messy rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from docweave.llm import spelling as sp

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_vocabulary(rows):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(AZ)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            run = run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run
            if len(run) >= 7:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 2}


def plain_variants(count):
    form, out = {}, {}
    for w, n in count.items():
        others = [x for x in count if near(w, x)]
        best = min(others, key=lambda x: (-count[x], x), default=None)
        form[w] = best if best and count[best] >= 10 * n else None
        out[w] = len(others)
    rows = set()
    for w, n in count.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n, out[w], count.get(form[w])))
    return rows


@pytest.mark.parametrize("letters,n", [("ab", 300), ("abcdefghé", 400)])
def test_index_equals_all_pairs(letters, n):
    rng = random.Random(n)
    for g in (1, 2, 7, 9):
        words = sorted({"".join(rng.choice(letters) for _ in range(g + rng.randrange(2))) for _ in range(n)})
        codes = np.array([[ord(c) for c in w.ljust(g + 1, "\0")] for w in words], np.uint32)
        lengths = np.array([len(w) for w in words])
        total = Counter()
        for lo, hi in ((0, g // 2), (g // 2, g + 1)) if g > 1 else ((0, 2),):
            count, first = sp.near_in_block(codes, lengths, g, lo, hi)
            for i, w in enumerate(words):
                lcp = lambda x, w=w: next((k for k, (p, q) in enumerate(zip(w, x)) if p != q), min(len(w), len(x)))
                want = [k for k, x in enumerate(words) if near(w, x) and min(len(w), len(x)) == g and lo <= lcp(x) < hi]
                assert count[i] == len(want) and first[i] == (want[0] if want else -1)
                total[i] += len(want)


def _words(rng, n):
    base = ["".join(rng.choice("abcé") for _ in range(rng.randrange(7, 12))) for _ in range(n)]
    return {w: rng.choice([2, 3, 25, 40, 400, 5000]) for w in base} | {"x" * 3000: 4, "x" * 2999: 90, "x" * 2998 + "y": 2}


@pytest.mark.parametrize("limit", [2, 16, 4096])
def test_large_keys_are_split_exactly(spark, limit):
    count = _words(random.Random(5), 250)
    df = spark.createDataFrame(list(count.items()), "word string, n long").repartition(3)
    got = {tuple(r) for r in sp.variants(df, limit=limit).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == plain_variants(count)


def test_messy_documents(spark):
    rng = random.Random(8)
    words = ["Wonderful", "wonderfull", "wonderfu1", "wunderful", "won×derful", "Überraschung", "überraschung", "short", "a" * 500]
    rows = [(k if k % 6 else None, " ".join(rng.choice(words) for _ in range(40))) for k in range(60)]
    rows += [rows[3], rows[3], (1, None), (2, ""), (3, " \n 123 "), (4, "Wonderful" * 9000), (5, "Wonderful" * 9000), (6, "wonderful " * 5000)]
    schema = "doc_id long, text string, word string, n long, `i.h` string"
    docs = spark.createDataFrame([(*r, "w", 1, "x") for r in rows], schema)
    vocabulary = sp.vocabulary(docs)
    count = plain_vocabulary(rows)
    assert {tuple(r) for r in vocabulary.collect()} == set(count.items())
    got = {tuple(r) for r in sp.variants(vocabulary).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == plain_variants(count) and any(r[1] for r in got)
    assert sp.variants(sp.vocabulary(docs.limit(0))).count() == 0
