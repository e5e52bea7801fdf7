"""Shards that all hold the mixture of the sources.

Proportional stratified interleaving: the rows of each source are shuffled by
a seeded hash and ranked; row ``r`` of ``n`` stands at ``(r + 0.5) / n`` of its
source, and all rows are sorted by that fraction. Any stretch of the order then
holds every source in proportion, so equal cuts give shards whose counts differ
by one at most and whose share of a source differs from the whole by less than
two rows.

Both orders are range-partitioned by sampled bounds down to single rows, so a
source of any size is split over tasks; a source's size reaches its rows by
``join_unique``, which spreads hot keys.

Defined cases: null is a source of its own, a null id or text counts as empty,
equal rows are told apart by nothing and take neighbouring ranks, fractions
that tie go by a seeded hash of the source; an empty table gives an empty
table, fewer rows than shards leave shards empty; extra columns are carried
untouched in ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import as_row, col, join_unique
from docweave.plans.ordering import dense_index

SHARDS = 8
SEED = 11


def seeded(seed: int, value: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(value.cast("string"), F.lit(""))).cast("binary"))


def text_size(text: Column) -> Column:
    """Bytes of the text in UTF-8 and one more for its end."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def text_crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def interleave(df: DataFrame, *, shards: int = SHARDS, seed: int = SEED, source_col: str = "source",
               id_col: str = "doc_id", tie: Column | None = None) -> DataFrame:
    """``(row, shard, slot)``: ``row`` holds the columns of ``df``; slots count
    from 0 within a shard. ``tie`` orders rows of one id."""
    source = F.when(col(source_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), col(source_col).cast("string")))
    rows = as_row(df.withColumns({"__source": source, "__order": F.struct(
        seeded(seed, col(id_col)).alias("hash"), col(id_col).alias("id"), (F.lit(0) if tie is None else tie).alias("tie"))}))
    rows = rows.select(F.struct(*[F.col("row")[c].alias(c) for c in df.columns]).alias("row"),
                       F.col("row.__source").alias("source"), F.col("row.__order").alias("order"))
    # equal rows are dealt out too: the last part of the key is each row's own
    keyed = rows.withColumn("key", F.struct("source", "order", F.monotonically_increasing_id().alias("own")))
    ranked = dense_index(keyed, "key", "at").drop("key")
    sources = ranked.groupBy("source").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    placed = join_unique(ranked, sources, "source", "n").withColumn(
        "key", F.struct(((F.col("at") - F.col("first") + 0.5) / F.col("n")).alias("fraction"),
                        seeded(seed, F.col("source")).alias("turn"), F.col("at")))
    order = dense_index(placed.select("row", "key"), "key", "at")
    n, at = sources.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar(), F.col("at")
    cut = order.withColumn("n", n).withColumn("shard", F.expr(f"cast(at * {int(shards)} div n as int)"))
    first = F.expr(f"(shard * n + {int(shards) - 1}) div {int(shards)}")
    return cut.select("row", "shard", (at - first).alias("slot"))


def write_shards(df: DataFrame, path: str, **how) -> None:
    """One folder per shard, its rows in the order of their slots file by
    file: the interleaved order is contiguous, so nothing is shuffled again."""
    found = interleave(df, **how)
    found.select(*[F.col("row")[c].alias(c) for c in df.columns], "shard", "slot").write.partitionBy("shard").parquet(path)
