"""Skew-safe building blocks for ordered work inside groups.

A conversation (or document) may hold a large share of all rows. A plain
``Window.partitionBy(conv)`` would sort such a group inside one task. These
helpers split every group into order-range buckets, do the per-row work per
(group, bucket) in parallel, and stitch buckets together through a small
per-bucket table (one row per bucket). After ``seq_number`` the "previous
row" is an equi-join on ``(group, seq - 1)``, which spreads a hot group over
all partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 4096


def _bucket(order: str, bucket_size: int | None) -> Column:
    size = BUCKET if bucket_size is None else bucket_size
    return F.floor(F.col(order) / F.lit(size)).cast("long")


def seq_number(df: DataFrame, keys: list[str], order: str, out: str = "seq",
               bucket_size: int | None = None) -> DataFrame:
    """1-based position of each row within ``keys`` ordered by ``order``
    (ties broken arbitrarily but deterministically by the remaining sort).

    Rows are numbered inside (keys, bucket) windows; each bucket's offset is a
    running sum over the per-bucket counts, a table of one row per bucket."""
    d = df.withColumn("__b", _bucket(order, bucket_size))
    d = d.withColumn("__w", F.row_number().over(
        Window.partitionBy(*keys, "__b").orderBy(order)))
    counts = d.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(
        Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0))).drop("__n")
    return (d.join(offsets, [*keys, "__b"]).withColumn(out, (F.col("__off") + F.col("__w")).cast("long"))
            .drop("__b", "__w", "__off"))


def with_previous(df: DataFrame, keys: list[str], seq: str, cols: list[str],
                  prefix: str = "prev_") -> DataFrame:
    """Adds ``prev_<c>`` = value of ``c`` on the row at ``seq - 1`` (null on
    the first row). An equi-join on (keys, seq): no window over the group."""
    prev = df.select(*keys, (F.col(seq) + 1).alias(seq), *[F.col(c).alias(prefix + c) for c in cols])
    return df.join(prev, [*keys, seq], "left")


def running_max(df: DataFrame, keys: list[str], order: str, value: Column, out: str,
                bucket_size: int | None = None) -> DataFrame:
    """Running (inclusive) max of ``value`` within ``keys`` by ``order``;
    per-bucket running max plus the max of all earlier buckets."""
    d = df.withColumn("__b", _bucket(order, bucket_size)).withColumn("__v", value)
    d = d.withColumn("__in", F.max("__v").over(
        Window.partitionBy(*keys, "__b").orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    per_b = d.groupBy(*keys, "__b").agg(F.max("__v").alias("__bm"))
    carry = per_b.withColumn("__carry", F.max("__bm").over(
        Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    ).drop("__bm")
    return (d.join(carry, [*keys, "__b"]).withColumn(out, F.greatest("__in", "__carry"))
            .drop("__b", "__v", "__in", "__carry"))


def ordered_concat(df: DataFrame, keys: list[str], order: str, value: str, sep: str,
                   out: str, bucket_size: int | None = None) -> DataFrame:
    """``sep``-joined ``value`` per ``keys`` in ``order``. Partial strings are
    built per (keys, bucket) in parallel; the final step joins one partial per
    bucket."""
    part = (df.withColumn("__b", _bucket(order, bucket_size))
            .groupBy(*keys, "__b")
            .agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"),
                                                       F.col(value).alias("v")))).alias("__s"))
            .select(*keys, "__b", F.array_join(F.transform("__s", lambda s: s["v"]), sep).alias("__p")))
    return (part.groupBy(*keys)
            .agg(F.sort_array(F.collect_list(F.struct("__b", "__p"))).alias("__s"))
            .select(*keys, F.array_join(F.transform("__s", lambda s: s["__p"]), sep).alias(out)))
