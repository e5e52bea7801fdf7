"""Exact neighbour searches that visit only part of the vectors.

A bounded number of vectors, picked by a hash of their ids, are pivots; every
vector belongs to the cell of its nearest pivot, and a cell knows its radius.
By the triangle inequality a query with bound ``r`` can find something nearer
than ``r`` only in cells whose pivot lies within ``r`` plus the radius. Each
query is shipped to those cells alone. Cells of more than ``CELL_BLOCK`` rows
are cut by a hash of the id, so no task holds more than a block of them.

Pivots, counts and radii (``MAX_PIVOTS`` rows at most) are all that is collected
or broadcast. A cell that many queries reach is copied to as many groups as
``QUERY_BLOCK`` asks for. Where little can be excluded, so that shipping the
queries to their cells would take more rows than blocks of queries against
blocks of vectors, those blocks are searched instead. Distances used for pruning carry a bound of their rounding error;
what a cell finds is scored exactly, as ``topk`` does.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.session import reliable_checkpoint

MAX_PIVOTS = 1024
CELL_BLOCK = 8192
QUERY_BLOCK = 16384
BLOCK_BYTES = 64 << 20  # of the vectors (as float64) on one side of a block pair
SENT_BYTES = 8 << 20  # of the vectors that a task routes at a time
_CHUNK = 1024


def block_rows(limit: int, dim: int) -> int:
    """Rows of a block of vectors: ``limit``, fewer if they are long."""
    return max(1, min(limit, BLOCK_BYTES // (8 * max(dim, 1))))


def wire(df: DataFrame, name: str):
    """A vector column as it is shipped: float arrays stay float32, anything
    else becomes float64."""
    t = df.schema[name].dataType
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.FloatType):
        return F.col(name)
    return F.col(name).cast("array<double>")


def matrix(arr: pa.Array, dim: int) -> np.ndarray:
    flat = arr.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(arr), dim)


def pivot_distances(q: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances to the pivots and, per query, what rounding may add to or
    take from one of them."""
    qq, pp = (q * q).sum(1), (pivots * pivots).sum(1)
    squares = np.maximum(qq[:, None] + pp[None, :] - 2.0 * (q @ pivots.T), 0.0)
    error = 16.0 * (q.shape[1] + 4) * np.finfo(np.float64).eps * (qq + pp.max(initial=0.0))
    return np.sqrt(squares), np.sqrt(error)


class PivotCells:
    """``rows``: ``(id, v, cell, sub)`` of the vectors, and the cells' facts."""

    def __init__(self, vectors: DataFrame, id_col: str, vec_col: str, dim: int, *,
                 max_pivots: int = MAX_PIVOTS, block: int = CELL_BLOCK):
        self.spark, self.dim = vectors.sparkSession, dim
        vs = vectors.select(F.col(id_col).cast("long").alias("id"), wire(vectors, vec_col).alias("v")).filter("v is not null")
        n = vs.count()
        m = min(max_pivots, math.ceil(math.sqrt(n)))
        picked = vs.orderBy(F.xxhash64("id"), "id").limit(m).collect()
        self.pivot_ids = np.array([r["id"] for r in picked], np.int64)
        self.pivots = np.array([r["v"] for r in picked], np.float64).reshape(-1, dim)
        sent = self.spark.sparkContext.broadcast(self.pivots)

        def assign(batches):
            for batch in batches:
                v = matrix(batch.column("v"), dim)
                cell, far = np.zeros(len(v), np.int32), np.zeros(len(v))
                for a in range(0, len(v), _CHUNK):
                    part = v[a:a + _CHUNK]
                    cell[a:a + _CHUNK] = pivot_distances(part, sent.value)[0].argmin(axis=1)
                    far[a:a + _CHUNK] = np.sqrt(((part - sent.value[cell[a:a + _CHUNK]]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cell), pa.array(far)],
                                                 names=["id", "v", "cell", "far"])

        dealt = reliable_checkpoint(vs.mapInArrow(assign, T.StructType([*vs.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])))
        facts = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()
        self.count, self.radius = np.zeros(max(m, 1), np.int64), np.zeros(max(m, 1))
        for r in facts:
            self.count[r["cell"]], self.radius[r["cell"]] = r["n"], r["far"] * (1 + 1e-12)
        self.subs = np.maximum(1, -(-self.count // block_rows(block, dim)))
        parts = self.spark.createDataFrame([(k, int(s)) for k, s in enumerate(self.subs)], "cell int, subs int")
        self.rows = dealt.join(F.broadcast(parts), "cell").select(
            "id", "v", "cell", F.pmod(F.xxhash64("id"), F.col("subs")).cast("int").alias("sub"))

    def reached(self, q: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Queries x cells: whether something within the bound may be there."""
        d, error = pivot_distances(q, self.pivots)
        return (d - self.radius[None, :] <= (bound + error)[:, None] * (1 + 1e-12)) & (self.count > 0)[None, :]

    def facts(self):
        """What routing needs, to be broadcast: a plain copy without Spark."""
        other = object.__new__(PivotCells)
        other.dim, other.pivots, other.pivot_ids = self.dim, self.pivots, self.pivot_ids
        other.count, other.radius, other.subs = self.count, self.radius, self.subs
        return other

    def shipped(self, at: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, cell) pairs spread over the parts of each cell."""
        parts = self.subs[cell]
        sub = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        return np.repeat(at, parts), np.repeat(cell, parts).astype(np.int32), sub.astype(np.int32)


def meet(visits: DataFrame, cells: DataFrame, search, schema: str, *, block: int | None = None) -> DataFrame:
    """``search(visits, cell rows)`` for each part of a cell, the visits of a
    part cut into groups of about ``block``. ``visits`` is read twice."""
    at = ["cell", "sub"]
    load = visits.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / F.lit(block or QUERY_BLOCK)).cast("int").alias("groups"))
    left = visits.join(load, at).withColumn("group", F.pmod(F.xxhash64("q_id"), F.col("groups")).cast("int")).drop("groups")
    right = cells.join(load, at).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    return left.groupBy(*at, "group").cogroup(right.groupBy(*at, "group")).applyInPandas(search, schema)


def _stack(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64).reshape(len(column), dim)


def pivot_knn(queries: DataFrame, cells: PivotCells, k: int, *, exclude_self: bool = False,
              counts: list | None = None) -> DataFrame:
    """Exact ``(q_id, b_id, score, rank)`` for queries ``(q_id, q_vec)``, as
    ``topk.knn`` by squared L2. A query first searches its own cell; the k-th
    distance found there bounds the cells it still has to visit. ``counts``
    gets the number of (query, cell part) visits of both steps."""
    from docweave.plans.topk import _partial_topk

    dim, spark = cells.dim, cells.spark
    if not cells.count.any():
        return spark.createDataFrame([], "q_id long, b_id long, score double, rank int")
    sent = spark.sparkContext.broadcast(cells.facts())
    qs = queries.select(F.col("q_id").cast("long").alias("q_id"), wire(queries, "q_vec").alias("q_vec"))
    schema = T.StructType([*qs.schema.fields, T.StructField("bound", T.DoubleType()), T.StructField("cell", T.IntegerType()), T.StructField("sub", T.IntegerType())])
    need = k + bool(exclude_self)
    sent_rows = max(1, SENT_BYTES // (8 * dim))

    def route(first: bool):
        def run(batches):
            c = sent.value
            for batch in batches:
                for a in range(0, batch.num_rows, _CHUNK):
                    part = batch.slice(a, _CHUNK)
                    q = matrix(part.column("q_vec"), dim)
                    d, error = pivot_distances(q, c.pivots)
                    own = np.where(c.count[None, :] > 0, d, np.inf).argmin(axis=1)
                    if first:  # where enough vectors lie for certain
                        bound = np.full(len(q), np.inf)
                        reach = np.where(c.count[None, :] > 0, d + c.radius[None, :], np.inf)
                        order = np.argsort(reach, axis=1)
                        held = np.cumsum(c.count[order], axis=1)
                        some = held[:, -1] >= need
                        at = (held >= need).argmax(axis=1)
                        rows = np.arange(len(q))
                        bound[some] = (reach[rows, order[rows, at]] + error)[some]
                        at, cell = rows, own
                    else:
                        bound = part.column("bound").to_numpy()
                        there = c.reached(q, bound)
                        there[np.arange(len(q)), own] = False
                        at, cell = np.nonzero(there)
                    # a query may go to every cell: some of its copies at a time
                    at, cell, sub = c.shipped(at, cell)
                    for s in range(0, len(at), sent_rows):
                        some = slice(s, s + sent_rows)
                        take = pa.array(at[some])
                        yield pa.RecordBatch.from_arrays([part.column("q_id").take(take), part.column("q_vec").take(take),
                                                          pa.array(bound[at[some]]), pa.array(cell[some]), pa.array(sub[some])],
                                                         names=["q_id", "q_vec", "bound", "cell", "sub"])
        return run

    def visits_of(batches):
        c = sent.value
        for batch in batches:
            n = 0
            for a in range(0, batch.num_rows, _CHUNK):
                part = batch.slice(a, _CHUNK)
                n += int((c.reached(matrix(part.column("q_vec"), dim), part.column("bound").to_numpy()) * c.subs[None, :]).sum())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([n])], names=["rows", "visits"])

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({"q_id": [], "b_id": [], "score": []})
        q, b, s = _partial_topk(_stack(left["q_vec"], dim), left["q_id"].to_numpy(np.int64), _stack(right["v"], dim),
                                right["id"].to_numpy(np.int64), k, "l2", exclude_self)
        return pd.DataFrame({"q_id": q, "b_id": b, "score": s})

    found = lambda visits: meet(visits.select("q_id", "q_vec", "cell", "sub"), cells.rows, search, "q_id long, b_id long, score double",
                                block=block_rows(QUERY_BLOCK, dim))
    w = Window.partitionBy("q_id").orderBy("score", "b_id")
    best = lambda df: df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    home = reliable_checkpoint(qs.mapInArrow(route(True), schema))
    near = reliable_checkpoint(best(found(home)).drop("rank"))
    kth = near.groupBy("q_id").agg(F.max("score").alias("kth"), F.count(F.lit(1)).alias("n"))
    bounds = home.groupBy("q_id").agg(F.first("bound").alias("loose")).join(kth, "q_id", "left").select("q_id", F.when(
        F.col("n") >= k, F.least(F.sqrt("kth") * (1 + 1e-12), "loose")).otherwise(F.col("loose")).alias("bound"))
    bounded = qs.join(bounds, "q_id")
    asked = bounded.mapInArrow(visits_of, "rows long, visits long").agg(F.sum("rows").alias("n"), F.sum("visits").alias("visits")).first()
    n_q, n_b = asked["n"] or 0, int(cells.count.sum())
    q_blocks, b_blocks = (max(1, math.ceil(n / block_rows(size, dim))) for n, size in ((n_q, QUERY_BLOCK), (n_b, 4 * CELL_BLOCK)))
    if (asked["visits"] or 0) > n_q * b_blocks + n_b * q_blocks:
        if counts is not None:
            counts += [home.count(), n_q * b_blocks]
        return best(_block_knn(qs, cells, k, exclude_self, q_blocks, b_blocks))
    away = reliable_checkpoint(bounded.mapInArrow(route(False), schema))
    if counts is not None:
        counts += [home.count(), away.count()]
    return best(near.unionByName(found(away)))


def _block_knn(qs: DataFrame, cells: PivotCells, k: int, exclude_self: bool, q_blocks: int, b_blocks: int) -> DataFrame:
    """The best ``k`` of each pair of a query block and a vector block, all
    pairs being searched."""
    from docweave.plans.topk import _partial_topk

    dim = cells.dim
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = qs.select("q_id", "q_vec", dealt("q_id", q_blocks).alias("qb")).withColumn("bb", every(b_blocks))
    right = cells.rows.select("id", "v", dealt("id", b_blocks).alias("bb")).withColumn("qb", every(q_blocks))

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        q, v = (matrix(t.column(c).combine_chunks(), dim) for t, c in ((a, "q_vec"), (b, "v")))
        found = _partial_topk(q, a.column("q_id").to_numpy(), v, b.column("id").to_numpy(), k, "l2", exclude_self)
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())],
                        names=["q_id", "b_id", "score"])

    return left.groupBy("qb", "bb").cogroup(right.groupBy("qb", "bb")).applyInArrow(search, "q_id long, b_id long, score double")
