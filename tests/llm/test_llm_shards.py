"""Mixture shards against a plain version, hot sources and messy rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from docweave.llm import mixture_shards as ms
from docweave.llm.registry import QUERIES

SCHEMA = "doc_id long, text string, source string, row string, at long, n long, key string, shard string, `a.b` string"


def _md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def plain(rows, shards, seed):
    """``{(id, crc, size): [(shard, slot)]}`` for rows ``(id, source, crc, size)``."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    placed = []
    for source, mine in by.items():
        mine.sort(key=lambda r: (_md5(f"{seed}:{'' if r[0] is None else r[0]}"), r[0] is not None, r[0] or 0, r[2], r[3]))
        turn = _md5(f"{seed}:" + ("-" if source is None else "+" + source))
        placed += [((k + 0.5) / len(mine), turn, k, r) for k, r in enumerate(mine)]
    placed.sort(key=lambda x: x[:3])
    out, slots = Counter(), Counter()
    for k, (*_, r) in enumerate(placed):
        shard = shards * k // len(placed)
        out[(r[0], r[2], r[3], shard, slots[shard])] += 1
        slots[shard] += 1
    return out


def _found(df, shards, seed):
    d = df.withColumns({"crc": ms.text_crc(F.col("text")), "size": ms.text_size(F.col("text"))})
    got = ms.interleave(d, shards=shards, seed=seed, tie=F.struct("crc", "size"))
    return Counter(tuple(r) for r in got.select("row.doc_id", "row.crc", "row.size", "shard", "slot").collect())


def _messy():
    rows = [(k if k % 9 else None, f"text {k % 13}" if k % 7 else None, [None, "hot", "hot", "a", ""][k % 5]) for k in range(200)]
    rows += [(4, "same", "hot")] * 40 + [(5, "", "b"), (6, "x" * 200_000, "b")]
    return [(*r, "row", 1, 2, "k", "s", "dot") for r in rows]


def test_equals_the_plain_version(spark):
    rows = _messy()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    data = [(r[0], r[2], zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 1) for r in rows]
    for shards, seed in ((8, 11), (3, 5), (1, 0)):
        assert _found(docs, shards, seed) == plain(data, shards, seed)


def test_carries_columns_and_takes_empty_and_tiny_tables(spark):
    docs = spark.createDataFrame(_messy(), SCHEMA)
    got = ms.interleave(docs.limit(3))
    assert got.select("row.*").columns == docs.columns
    assert sorted(r["shard"] for r in got.collect()) == [0, 2, 5]
    assert ms.interleave(docs.limit(0)).count() == 0


def test_shards_hold_the_mixture(spark, sf, tmp_path):
    got = QUERIES["op11_mixture_shards"](spark, sf).collect()
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    assert all({r["slot"] for r in got if r["shard"] == s} == set(range(counts[s])) for s in counts)
    sources = Counter(r["source"] for r in got)
    for s in counts:
        mine = Counter(r["source"] for r in got if r["shard"] == s)
        assert all(abs(mine[x] - n * counts[s] / len(got)) < 2 for x, n in sources.items())


def test_written_shards_are_in_slot_order(spark, tmp_path):
    docs = spark.createDataFrame(_messy(), SCHEMA).drop("shard")
    ms.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count()
    one = [r["slot"] for r in spark.read.parquet(str(tmp_path / "out/shard=0")).coalesce(1).collect()]
    assert sorted(one) == list(range(len(one)))


def test_a_table_of_one_row_repeated_is_spread(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("t").alias("text"), F.lit("s").alias("source"))
    got = ms.interleave(docs)
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 4 and Counter(r["shard"] for r in got.collect()) == {k: 375 for k in range(8)}
