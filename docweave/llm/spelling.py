"""Grouping of spelling variants with a bit-sliced position index.

Words that differ by one inserted, deleted or replaced code point are near. In
a block of words, a bitset for every (position, letter) tells which words hold
the letter there. For a query word, recurrences over its letters keep four
sets of the whole block at once, 64 words to a machine word: no error so far,
one replaced, one inserted (positions shifted on) and one deleted (positions
shifted back).

Which words meet in a block: two near words of ``g`` and ``g`` or ``g + 1``
letters first differ at some position ``e``. For a region ``[lo, hi)`` of ``e``
they share the first ``lo`` letters and the last ``g - hi``, so these two are a
key under which words shuffle. Regions start as the two halves; a key with more
than ``LIMIT`` words is halved again until its region is one position, where
the two free letters bound it. Every near pair is found under exactly one key,
whatever the vocabulary, and no group is ever cut short or paired in full.

Defined cases: null text holds no words, repeated rows count each time, an
empty table gives an empty table; letters are code points, words of any length
take part; other columns play no role.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import col
from docweave.session import reliable_checkpoint

LETTERS = "A-Za-z\\u00C0-\\u00FF"
LIMIT = 4096
BLOCK_WORDS = 1024
BLOCK_LETTERS = 1 << 22
_WORDS = "word string, n long"
_FOUND = "word string, n_near long, near string, near_n long"


def vocabulary(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, least: int = 2,
               modulus: int = 31) -> DataFrame:
    """``(word, n)``: lower-cased runs of letters of at least ``shortest`` code
    points that occur ``least`` times; of every run whose hash with the id is
    divisible by ``modulus`` one letter is dropped first."""
    runs = df.select(F.coalesce(col(id_col).cast("string"), F.lit("")).alias("i"), F.explode(
        F.regexp_extract_all(col(text_col), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))).alias("run"))
    low = runs.select("i", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("w"))
    hashed = low.withColumn("h", F.crc32(F.concat("i", F.lit(":"), "w").cast("binary")))
    at = (F.col("h") % F.length("w")).cast("int")
    word = F.when(F.col("h") % modulus == 0, F.concat(F.substring(F.col("w"), F.lit(1), at), F.substring(
        F.col("w"), at + 2, F.length("w")))).otherwise(F.col("w"))
    return (hashed.select(word.alias("word")).filter(F.length("word") >= shortest)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least))


# ------------------------------------------------------------- one block

def near_in_block(letters: np.ndarray, lengths: np.ndarray, g: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Per word of a block how many others are near, and the first of them
    (-1: none). ``letters`` is words x (g + 1), lengths are g or g + 1; counted
    are pairs whose first difference lies in ``[lo, hi)``."""
    n, width = len(letters), (len(letters) + 63) // 64
    short, long = np.flatnonzero(lengths == g), np.flatnonzero(lengths == g + 1)
    bits = lambda mask: np.packbits(np.pad(mask, (0, width * 64 - n)), bitorder="little").view(np.uint64)
    alphabet, code = np.unique(letters, return_inverse=True)
    code = code.reshape(letters.shape)
    held: dict[int, np.ndarray] = {}

    def index(p: int) -> np.ndarray:
        """Bitsets of the words that hold each letter at position ``p``."""
        if p not in held:
            there = np.zeros((len(alphabet), width * 64), bool)
            there[code[:, p], np.arange(n)] = True
            there[:, :n] &= p < lengths
            held[p] = np.packbits(there, axis=1, bitorder="little").view(np.uint64)
            held.pop(p - 3, None)
        return held[p]

    of_short, of_long = bits(lengths == g), bits(lengths == g + 1)
    count, first = np.zeros(n, np.int64), np.full(n, -1, np.int64)

    def note(query: np.ndarray, found: np.ndarray) -> None:
        count[query] = np.bitwise_count(found).sum(axis=1)
        some = found != 0
        at = some.argmax(axis=1)
        word = found[np.arange(len(query)), at]
        low = np.bitwise_count((word & (~word + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        first[query] = np.where(some.any(axis=1), at * 64 + low, -1)

    def marks(step: int, same: np.ndarray, kept: dict[int, np.ndarray]) -> None:
        if step in (lo, hi):
            kept[step] = same.copy()

    # queries of g letters: others of g with one replaced, of g + 1 with one more
    same = np.tile(bits(np.ones(n, bool)), (len(short), 1))
    replaced, more, at = np.zeros_like(same), np.zeros_like(same), {}
    marks(0, same, at)
    for i in range(g):
        letter = code[short, i]
        here = index(i)[letter]
        more = (more | same) & index(i + 1)[letter]
        replaced = (replaced & here) | (same & ~here)
        same &= here
        marks(i + 1, same, at)
    region = at[lo] & ~at[hi] if hi in at else at[lo]
    note(short, ((replaced & of_short) | ((more | same) & of_long)) & region)
    # queries of g + 1 letters: others of g, one letter of the query dropped
    held.clear()
    same = np.tile(bits(np.ones(n, bool)), (len(long), 1))
    fewer, at = np.zeros_like(same), {}
    marks(0, same, at)
    for i in range(g + 1):
        letter = code[long, i]
        fewer = (fewer & index(i - 1)[letter] if i else np.zeros_like(same)) | same
        same = same & index(i)[letter]
        marks(i + 1, same, at)
    region = at[lo] & ~at[hi] if hi in at else at[lo]
    note(long, fewer & of_short & region)
    return count, first


def _blocks(batches):
    """Runs of whole keys of one region, of about ``BLOCK_WORDS`` words, from
    rows sorted by region and key: lists of ``(word, n)`` with the region."""
    region, block, group, key, held = None, [], [], None, 0
    for batch in batches:
        data = batch.to_pydict()
        for g, lo, hi, k, word, n in zip(data["g"], data["lo"], data["hi"], data["key"], data["word"], data["n"]):
            if (g, lo, hi, k) != key:
                if len(group) > 1:
                    block += group
                group, here = [], (g, lo, hi)
                if block and (here != region or len(block) >= BLOCK_WORDS or len(block) * (g + 1) >= BLOCK_LETTERS):
                    yield region, block
                    block = []
                key, region = (g, lo, hi, k), here
            group.append((word, n))
    block += group if len(group) > 1 else []
    if block:
        yield region, block


def _search(batches):
    """Per block and word how many words are near, and of these the one of the
    largest count, ties by code points: words stand in that order in a block,
    so that it is the lowest bit."""
    for (g, lo, hi), block in _blocks(batches):
        block.sort(key=lambda x: (-x[1], x[0]))
        words = [w for w, _ in block]
        lengths = np.array([len(w) for w in words])
        letters = np.frombuffer("".join(w.ljust(g + 1, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(-1, g + 1)
        count, first = near_in_block(letters, lengths, g, lo, hi)
        some = np.flatnonzero(count)
        if len(some):
            best = [block[i] for i in first[some]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([words[i] for i in some]), pa.array(count[some]), pa.array([w for w, _ in best]),
                 pa.array([n for _, n in best], pa.int64())], names=["word", "n_near", "near", "near_n"])


# ---------------------------------------------------------------- in Spark

def _keyed(regions: DataFrame) -> DataFrame:
    """The key of each ``(word, n, g, lo, hi)``: first ``lo`` and last
    ``g - hi`` letters. Equal hashes of different keys do no harm, as only near
    words of the region are found."""
    tail = F.greatest(F.col("g") - F.col("hi"), F.lit(0))
    ends = F.xxhash64(F.substring(F.col("word"), F.lit(1), F.col("lo")),
                      F.substring(F.col("word"), F.length("word") - tail + 1, tail))
    return regions.withColumn("key", ends)


def _halves(regions: DataFrame, middle: Column) -> DataFrame:
    cut = regions.withColumn("mid", middle)
    both = F.array(F.struct(F.col("lo"), F.col("mid").alias("hi")), F.struct(F.col("mid").alias("lo"), F.col("hi")))
    return cut.withColumn("half", F.explode(both)).select("word", "n", "g", F.col("half.lo").alias("lo"), F.col("half.hi").alias("hi"))


def near_words(words: DataFrame, *, limit: int = LIMIT) -> DataFrame:
    """``(word, n_near, near, near_n)`` of ``(word, n)`` rows with distinct
    words: the number of near words, and the most frequent of them."""
    size = F.length("word")
    regions = words.select("word", "n", F.explode(F.array(size - 1, size)).alias("g")).filter("g > 0").select(
        "word", "n", "g", F.lit(0).alias("lo"), (F.col("g") + 1).alias("hi"))
    regions = _halves(regions, F.floor(F.col("g") / 2).cast("int"))
    found = None
    while regions is not None:
        keyed = _keyed(regions)
        by = ["g", "lo", "hi", "key"]
        heavy = reliable_checkpoint(keyed.filter("hi - lo > 1").groupBy(*by).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > limit))
        regions = None
        if not heavy.isEmpty():
            marked = keyed.join(heavy.hint("merge"), by, "left")
            regions = reliable_checkpoint(_halves(marked.filter("rows is not null"), F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")))
            keyed = marked.filter("rows is null").drop("rows")
        dealt = keyed.repartition(*by).sortWithinPartitions(*by)
        here = dealt.select(*by, "word", "n").mapInArrow(_search, _FOUND)
        found = here if found is None else found.unionByName(here)
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.col("best.w").alias("near"), (-F.col("best.n")).alias("near_n"))


def variants(words: DataFrame, *, times: int = 10, limit: int = LIMIT) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``. A form is at least ``times``
    as frequent, so chains are short; they are followed by doubling."""
    words = reliable_checkpoint(words)
    near = near_words(words, limit=limit)
    is_form = F.col("near_n") >= times * F.col("n")
    all_words = reliable_checkpoint(words.join(near.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")))
    step = all_words.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        after = step.select(F.col("word").alias("root"), F.col("root").alias("next")).hint("merge")
        jumped = reliable_checkpoint(step.join(after, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        step = jumped.select("word", "root")
        if jumped.filter("moved").isEmpty():
            break
    return all_words.join(step.hint("merge"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
