"""Exact deduplication by a content sort.

Every row gets the sort key (first 64 bytes of the normalised text, SHA-256 of
it, id). A bounded sample of keys, weighted by text size, gives splitters; rows
are range-partitioned by them, each partition is sorted by Spark's external
sort, so equal texts lie next to each other, and neighbours are compared in
full. The id is part of the key, so a text that a third of all rows share is
cut over as many partitions as its size asks for: only texts that a splitter
names can cross a border, and for these (at most one per border) the group is
counted beforehand by a grouped aggregation.

Defined cases: null text counts as empty; null ids are the least preferred;
rows that repeat id and text of the row that stays are dropped; an empty table
gives an empty result; extra columns are carried untouched.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import as_row, col, shuffle_partitions

HEAD = 64
SAMPLES_PER_PARTITION = 40
_LOW = -(1 << 63)


def _keyed(df: DataFrame, id_col: str, text_col: str, normalise, keep: str) -> DataFrame:
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    text = (normalise(text) if normalise else text).cast("binary")
    key_id = F.coalesce(col(id_col).cast("long"), F.lit(_LOW if keep == "max" else -_LOW - 1))
    return df.select(F.struct(*[col(c) for c in df.columns]).alias("row"), text.alias("text"), key_id.alias("id"))


def _with_digest(keyed: DataFrame) -> DataFrame:
    return keyed.select("*", F.substring("text", 1, HEAD).alias("head"), F.unhex(F.sha2("text", 256)).alias("sha"))


def _splitters(keyed: DataFrame, n: int, sign: int) -> list[tuple]:
    """Up to ``n - 1`` keys that cut the sampled bytes into equal shares."""
    total = keyed.count()
    if not total or n < 2:
        return []
    share = min(1.0, n * SAMPLES_PER_PARTITION / total)
    sample = _with_digest(keyed.sample(share, seed=17) if share < 1 else keyed).select(
        "head", "sha", "id", (F.octet_length("text") + 200).alias("w")).collect()
    sample = sorted((bytes(r["head"]), bytes(r["sha"]), sign * r["id"], r["w"]) for r in sample)
    step, seen, out = sum(r[3] for r in sample) / n, 0, []
    for head, sha, key_id, w in sample:
        seen += w
        if seen >= step * (len(out) + 1) and len(out) < n - 1 and (not out or out[-1] < (head, sha, key_id)):
            out.append((head, sha, key_id))
    return out


def _border_groups(keyed: DataFrame, splitters: list[tuple], keep: str) -> dict[bytes, tuple[int, int]]:
    """``sha -> (rows, id that stays)`` of the texts named by splitters."""
    if not splitters:
        return {}
    spark = keyed.sparkSession
    named = spark.createDataFrame(sorted({(h, s) for h, s, _ in splitters}),
                                  "head binary, named binary")
    heads = F.broadcast(named.select("head").distinct())
    near = keyed.withColumn("head", F.substring("text", 1, HEAD)).join(heads, "head", "left_semi")
    best = F.max("id") if keep == "max" else F.min("id")
    found = (near.withColumn("sha", F.unhex(F.sha2("text", 256)))
             .join(F.broadcast(named.select(F.col("named").alias("sha"))), "sha", "left_semi")
             .groupBy("sha").agg(F.count(F.lit(1)).alias("n"), best.alias("best")))
    return {bytes(r["sha"]): (r["n"], r["best"]) for r in found.collect()}


def _sorted_runs(df: DataFrame, id_col: str, text_col: str, normalise, keep: str):
    sign = -1 if keep == "max" else 1
    keyed = _keyed(df, id_col, text_col, normalise, keep)
    n = shuffle_partitions(df)
    splitters = _splitters(keyed, n, sign)
    groups = _border_groups(keyed, splitters, keep)

    @F.pandas_udf("int")
    def place(head, sha, key_id):
        import pandas as pd
        return pd.Series([bisect_left(splitters, (bytes(h), bytes(s), sign * int(i)))
                          for h, s, i in zip(head, sha, key_id)], dtype="int32")

    placed = _with_digest(keyed).withColumn("part", place("head", "sha", "id"))
    order = F.col("id").desc() if keep == "max" else F.col("id").asc()
    return placed.repartitionById(n, F.col("part")).sortWithinPartitions("part", "head", "sha", order), groups


def _compared(batches):
    """Each batch with its digests, ids and, per row, whether its text differs
    from the row before it (digests first, then the texts in full)."""
    last = None
    for batch in batches:
        shas, texts, starts = batch.column("sha").to_pylist(), batch.column("text"), []
        for i, sha in enumerate(shas):
            same = last is not None and last[0] == sha and last[1] == texts[i].as_py()
            if not same:
                last = (sha, texts[i].as_py())
            starts.append(not same)
        yield batch, shas, batch.column("id").to_pylist(), starts


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep: str = "max",
                normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, text_sha256``.
    ``keep`` tells whether the largest or the smallest id of equal texts stays."""
    placed, groups = _sorted_runs(df.select(col(id_col), col(text_col)), id_col, text_col, normalise, keep)
    missing = _LOW if keep == "max" else -_LOW - 1
    schema = "id long, keep_id long, group_size long, kept boolean, text_sha256 string"
    arrow = pa.schema([("id", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()),
                       ("kept", pa.bool_()), ("text_sha256", pa.string())])

    def close(ids, sha, out):
        """Adds one run of equal texts; ids come best first."""
        if ids:
            size, best = groups.get(sha, (len(ids), ids[0]))
            out[0] += [None if i == missing else i for i in ids]
            out[1] += [None if best == missing else best] * len(ids)
            out[2] += [size] * len(ids)
            out[3] += [k == 0 and i == best for k, i in enumerate(ids)]
            out[4] += [sha.hex()] * len(ids)

    def runs(batches):
        run, run_sha = [], b""
        for _, shas, ids, starts in _compared(batches):
            out = [[], [], [], [], []]
            for sha, i, new in zip(shas, ids, starts):
                if new:
                    close(run, run_sha, out)
                    run, run_sha = [], sha
                run.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, arrow.types)], schema=arrow)
        out = [[], [], [], [], []]
        close(run, run_sha, out)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, arrow.types)], schema=arrow)

    return placed.select("id", "sha", "text").mapInArrow(runs, schema)


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep: str = "max",
                      normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows that stay, with all their columns."""
    placed, groups = _sorted_runs(df, id_col, text_col, normalise, keep)
    schema = T.StructType([T.StructField("row", as_row(df).schema["row"].dataType)])

    def first(batches):
        for batch, shas, ids, starts in _compared(batches):
            stay = [i for i, new in enumerate(starts) if new and (shas[i] not in groups or groups[shas[i]][1] == ids[i])]
            yield batch.select(["row"]).take(pa.array(stay, pa.int64()))

    return placed.select("row", "id", "sha", "text").mapInArrow(first, schema).select("row.*")
