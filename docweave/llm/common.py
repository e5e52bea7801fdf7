"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1000


def col(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_row(df: DataFrame, name: str = "row") -> DataFrame:
    """All columns packed in one struct, so that no working column can clash
    with a column of the caller."""
    return df.select(F.struct(*[col(c) for c in df.columns]).alias(name))


def text_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(offsets, bytes)`` of a string or binary array; null counts as empty."""
    if array.null_count:
        array = pc.fill_null(array, b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if len(array) == 0 or offsets is None:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset:array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    base = int(off[0])
    return off.astype(np.int64) - base, raw[base:int(off[-1])]


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def join_unique(left: DataFrame, unique: DataFrame, key: str, weight: str) -> DataFrame:
    """Left join with a table that has one row per ``key``, safe for hot keys.

    ``weight`` is the number of left rows that a key meets. The ``HOT_KEYS``
    heaviest keys are broadcast (a bound that holds at any size), and rows that
    met one, or whose key is null, are dealt out by a hash of the row in the
    shuffle that joins the rest: any other key holds less than 1 / HOT_KEYS of
    the rows. ``key`` must be a string column in both; the columns of
    ``unique`` other than ``key`` are added."""
    extra = [c for c in unique.columns if c != key]
    hot = unique.orderBy(F.desc(weight), key).limit(HOT_KEYS)
    first = left.join(F.broadcast(hot.select(F.col(key), F.struct(*extra).alias("_hot"))), key, "left")
    dealt = F.concat(F.lit("\u0001"), F.xxhash64(*left.columns).cast("string"))
    spread = F.when(F.col("_hot").isNotNull() | F.col(key).isNull(), dealt).otherwise(F.col(key))
    rest = unique.select(F.col(key).alias("_spread"), F.struct(*extra).alias("_rest"))
    both = first.withColumn("_spread", spread).join(rest, "_spread", "left")
    found = F.coalesce("_hot", "_rest")
    return both.select(*left.columns, *[found[c].alias(c) for c in extra])
