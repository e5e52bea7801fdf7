"""Parallelism guard for CPU-heavy per-row stages (HTML parse, regex
chains, per-row scoring)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Round-robin the rows over the cluster's cores when the input has fewer
    partitions than cores (a few large files, a small table); with ``by``,
    rows of equal values stay together. On large inputs
    the partition count already exceeds the cores and nothing changes, so no
    shuffle is added at scale.

    Call it on scans (and row-wise projections of them) only: the partition
    count is read from ``DataFrame.rdd``, which is free for a scan but would
    run the map side of any shuffle below it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, *by)
    return df


def filter_computed(df: DataFrame, condition) -> DataFrame:
    """Filter on columns computed by ``df``'s last projection, evaluating
    them once. Catalyst pushes a filter below a projection by inlining the
    aliased expressions, which runs an expensive expression twice (once in
    the filter, once in the output). A one-element ``inline`` is a
    ``Generate`` the filter cannot be pushed through, so the projection is
    evaluated once and the filter reads its result."""
    from pyspark.sql import functions as F
    cols = df.columns
    boxed = df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in cols]))))
    return boxed.filter(condition)
