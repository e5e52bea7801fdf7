"""Exact k-nearest-neighbour join without emitting all pairs.

Three ways to bring queries and base rows together:

* **broadcast queries** when ``n_queries * dim * 8`` is under
  ``max_broadcast_bytes`` (checked by one collect of at most that size): every
  base partition computes, per Arrow batch, a partial top-k per query. Only
  ``k`` candidates per query per batch leave the task.
* **pivot cells** beyond that bound for L2 without groups (``pivots``): each
  query is shipped only to cells that the triangle inequality can't exclude.
* **block cogroup** for the rest, so that no query table ever passes
  through the driver: queries and base are hashed into ``Q x B`` blocks; cell
  ``(qb, bb)`` sees ``n_q/Q`` queries and ``n_b/B`` base rows and again emits
  only a partial top-k. Block sizes come from the counts.

In every case the final ``row_number() <= k`` runs over at most
``k * batches`` candidates per query, and Spark plans it with a partial
``WindowGroupLimit`` before the shuffle.

Inside a block a matrix product ranks approximately. Its rounding error is
bounded, every row that the bound can't exclude is scored exactly in float64
(difference form, summed left to right, as a SQL engine would), and ties go to
the smaller id. Equal vectors are one vector with its smallest ids, so copies
cost nothing. L2 blocks are centred first, so a common offset doesn't cancel.

Rows with a null vector take no part. A vector of another size than the first
query's (or ``dim``), or with a value that isn't finite, is an error;
``vector_status`` finds such rows beforehand.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from docweave.plans.pivots import PivotCells, pivot_knn, wire

MAX_BROADCAST_BYTES = 64 * 1024 * 1024
# Block-cogroup sizes. Each base row is shipped to every query block and
# each query row to every base block, so the shuffle is
# n_b * ceil(n_q / Q_BLOCK) + n_q * ceil(n_b / B_BLOCK) rows: large query
# blocks keep base replication low, and a cell holds at most
# (Q_BLOCK + B_BLOCK) vectors in memory (scored 1024 queries at a time).
Q_BLOCK = 16384
B_BLOCK = 32768
STAR_BLOCK = 16384
_EPS = float(np.finfo(np.float64).eps)
_PAIR_CHUNK = 1 << 18  # candidate pairs scored at a time
_SCORES = 1 << 21  # approximate scores held at a time (16 MiB)


def vector_status(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """``(id_col, status)`` of the rows that can't take part: ``null``,
    ``size`` (not ``dim`` values) or ``not_finite``."""
    v = F.col(vec_col)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    status = F.when(v.isNull(), "null").when(F.size(v) != dim, "size").when(odd, "not_finite")
    return df.select(id_col, status.alias("status")).filter("status is not null")


def _checked(m: np.ndarray, dim: int) -> np.ndarray:
    if m.shape[1:] != (dim,):
        raise ValueError(f"a vector has {m.shape[1:]} values, expected {dim}")
    if not np.isfinite(m).all():
        raise ValueError("a vector holds a value that is not finite")
    return m


def _to_matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list array as a float64 matrix; every list must have ``dim``
    finite values."""
    arr = pa.array(col) if not isinstance(col, pa.Array) else col
    if len(arr) == 0:
        return np.zeros((0, dim), dtype=np.float64)
    sizes = np.diff(arr.offsets.to_numpy())
    if (sizes != dim).any():
        raise ValueError(f"a vector has {int(sizes[sizes != dim][0])} values, expected {dim}")
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _checked(flat.reshape(-1, dim), dim)


def _stack(vectors, dim: int) -> np.ndarray:
    if len(vectors) == 0:
        return np.zeros((0, dim), dtype=np.float64)
    if any(len(v) != dim for v in vectors):
        raise ValueError(f"a vector doesn't have {dim} values")
    return _checked(np.stack(list(vectors)).astype(np.float64), dim)


def _seq_sum(m: np.ndarray) -> np.ndarray:
    """Row sums added left to right (the order a SQL list sum uses), so
    equal inputs give bit-equal scores in both engines."""
    acc = np.zeros(m.shape[0], dtype=np.float64)
    for j in range(m.shape[1]):
        acc += m[:, j]
    return acc


def _exact_pairs(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Exact scores of vector pairs (rows of ``q`` and ``v``), summed left to
    right over dimensions; smaller is better."""
    if metric == "l2":
        return _seq_sum((v - q) ** 2)
    den = np.sqrt(_seq_sum(q * q)) * np.sqrt(_seq_sum(v * v))
    return -np.where(den == 0, 0.0, _seq_sum(v * q) / np.where(den == 0, 1.0, den))


def _distinct(bm: np.ndarray, bids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a block without copies that can't be among the best: of
    equal vectors the ``keep`` smallest ids."""
    order = np.argsort(bids, kind="stable")
    bm, bids = bm[order] + 0.0, bids[order]  # -0.0 equals 0.0
    key = np.ascontiguousarray(bm).view(np.dtype((np.void, bm.shape[1] * bm.itemsize))).ravel()
    _, group, counts = np.unique(key, return_inverse=True, return_counts=True)
    if counts.max() <= keep:
        return bm, bids
    by = np.argsort(group, kind="stable")
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by)) - np.repeat(np.cumsum(counts) - counts, counts)
    stay = rank < keep
    return bm[stay], bids[stay]


def _approximate(q: np.ndarray, b: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Scores by a matrix product and, per query, a bound of their error."""
    d = q.shape[1]
    if metric == "l2":
        centre = b.mean(0)
        top = max(float(np.abs(b).max(initial=0.0)), float(np.abs(q).max(initial=0.0)))
        q, b = q - centre, b - centre
        qq, bb = (q * q).sum(1), (b * b).sum(1)
        size = qq + bb.max(initial=0.0)
        moved = 4.0 * _EPS * top * np.sqrt(d)  # what centring may move a vector by
        error = 8.0 * (d + 4) * _EPS * size + 4.0 * moved * np.sqrt(2.0 * size) + 4.0 * moved * moved
        return qq[:, None] + bb[None, :] - 2.0 * (q @ b.T), error
    den = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
    return -(q @ b.T) / np.where(den == 0, 1.0, den), np.full(len(q), 16.0 * (d + 4) * _EPS)


def _best_slices(qm, qids, bm, bids, k, metric, exclude_self):
    """Candidate ``(q_ids, b_ids, scores)`` arrays, one set for each slice of
    the queries: per query the best ``k`` of this block, exactly, by
    (score, id)."""
    if len(qm) == 0 or len(bm) == 0:
        return
    bm, bids = _distinct(bm, bids, k + bool(exclude_self))
    kk = min(len(bids), k)
    step = max(1, min(1024, _SCORES // max(1, bm.shape[0])))
    for start in range(0, len(qm), step):
        q, qi = qm[start:start + step], qids[start:start + step]
        approx, error = _approximate(q, bm, metric)
        if exclude_self:
            approx = np.where(qi[:, None] == bids[None, :], np.inf, approx)
        kth = np.partition(approx, kk - 1, axis=1)[:, kk - 1]
        near = approx <= (kth + 2.0 * error)[:, None]
        if exclude_self:
            near &= qi[:, None] != bids[None, :]
        row, base = np.nonzero(near)
        exact = np.empty(len(row))
        for a in range(0, len(row), _PAIR_CHUNK):
            part = slice(a, a + _PAIR_CHUNK)
            exact[part] = _exact_pairs(q[row[part]], bm[base[part]], metric)
        order = np.lexsort((bids[base], exact, row))
        row, base, exact = row[order], base[order], exact[order]
        first = np.searchsorted(row, row)
        best = np.arange(len(row)) - first < k
        yield qi[row[best]], bids[base[best]], exact[best]


def _partial_topk(qm, qids, bm, bids, k, metric, exclude_self):
    """The candidates of all queries of a bounded block as three arrays."""
    parts = list(_best_slices(qm, qids, bm, bids, k, metric, exclude_self))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*parts))


def knn(queries: DataFrame, base: DataFrame, k: int, *, q_id: str = "q_id",
        q_vec: str = "q_vec", b_id: str = "b_id", b_vec: str = "b_vec",
        group: str | None = None, metric: str = "l2", exclude_self: bool = False,
        max_broadcast_bytes: int = MAX_BROADCAST_BYTES, dim: int | None = None) -> DataFrame:
    """Exact top-``k`` of ``base`` for every query.

    Returns ``(q_id, b_id[, group], score, rank)``: ``score`` is the squared
    L2 distance (``metric="l2"``) or the cosine similarity
    (``metric="cosine"``); ``rank`` is 1..k ordered by (distance, b_id) or
    (similarity desc, b_id). With ``group``, the top-k is taken within each
    (query, group) pair (one index per document)."""
    spark = queries.sparkSession
    # float32 vectors cross to Python as float32 (half the Arrow bytes);
    # scores are always computed in float64
    qs = queries.select(F.col(q_id).cast("long").alias("q_id"),
                        wire(queries, q_vec).alias("q_vec")).filter(F.col("q_vec").isNotNull())
    bcols = [F.col(b_id).cast("long").alias("b_id"), wire(base, b_vec).alias("b_vec")]
    if group:
        bcols.append(F.col(group).alias("grp"))
    bs = base.select(*bcols).filter(F.col("b_vec").isNotNull())
    # at most cap + 1 query rows are collected: a bounded set is broadcast from
    # that same collect, a larger one goes to the block cogroup
    if dim is None:
        first = qs.select(F.size("q_vec").alias("d")).limit(1).collect()
        dim = int(first[0]["d"]) if first else 0
        if first and dim == 0:
            raise ValueError("the first query has a vector without values")
    cap = max_broadcast_bytes // (8 * max(dim, 1))
    qpdf = qs.limit(cap + 1).toPandas() if dim else None
    n_q = 0 if qpdf is None else len(qpdf)
    grp_type = base.schema[group].dataType if group else None
    grp_arrow = to_arrow_type(grp_type) if group else None
    cand_fields = [T.StructField("q_id", T.LongType()), T.StructField("b_id", T.LongType())]
    if group:
        cand_fields.append(T.StructField("grp", grp_type))
    cand_fields.append(T.StructField("score", T.DoubleType()))
    cand_schema = T.StructType(cand_fields)

    if n_q == 0 or dim == 0:
        return spark.createDataFrame([], cand_schema).withColumn("rank", F.lit(1))

    if n_q <= cap:
        qm_b = spark.sparkContext.broadcast(
            (_stack(qpdf["q_vec"].to_numpy(), dim), qpdf["q_id"].to_numpy(dtype=np.int64)))

        def run(batches):
            qm, qids = qm_b.value
            for batch in batches:
                bm = _to_matrix(batch.column("b_vec"), dim)
                bids = batch.column("b_id").to_numpy(zero_copy_only=False).astype(np.int64)
                groups = batch.column("grp").to_numpy(zero_copy_only=False) if group else None
                for g in (pd.unique(groups) if group else [None]):
                    sel = np.nonzero(groups == g)[0] if group else slice(None)
                    # a slice of the queries at a time, so no task holds candidates of them all
                    for a, b, s in _best_slices(qm, qids, bm[sel], bids[sel], k, metric, exclude_self):
                        of = [pa.array([g] * len(a), grp_arrow)] if group else []
                        arrays = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), *of, pa.array(s, pa.float64())]
                        yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema(
                            [pa.field(f.name, x.type) for f, x in zip(cand_schema.fields, arrays)]))

        cands = bs.mapInArrow(run, cand_schema)
    elif metric == "l2" and not group:
        odd = lambda df, v: df.filter((F.size(v) != dim) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        if not odd(qs, "q_vec").unionByName(odd(bs.toDF("q_id", "q_vec"), "q_vec")).isEmpty():
            raise ValueError(f"a vector doesn't have {dim} finite values")
        # of equal vectors only the smallest ids can be among the best
        copies = Window.partitionBy("b_vec").orderBy("b_id")
        few = (bs.withColumn("b_vec", F.transform("b_vec", lambda x: x + F.lit(0.0).cast(bs.schema["b_vec"].dataType.elementType)))
               .withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + int(exclude_self)).drop("copy"))
        cells = PivotCells(few, "b_id", "b_vec", dim)
        return pivot_knn(qs, cells, k, exclude_self=exclude_self).select("q_id", "b_id", "score", "rank")
    else:
        n_q = qs.count()
        n_b = bs.count()
        nq_blocks = max(1, math.ceil(n_q / Q_BLOCK))
        nb_blocks = max(1, math.ceil(n_b / B_BLOCK))
        qx = qs.withColumn("qb", F.pmod(F.xxhash64("q_id"), F.lit(nq_blocks))).withColumn(
            "bb", F.explode(F.sequence(F.lit(0), F.lit(nb_blocks - 1))))
        bx = bs.withColumn("bb", F.pmod(F.xxhash64("b_id"), F.lit(nb_blocks))).withColumn(
            "qb", F.explode(F.sequence(F.lit(0), F.lit(nq_blocks - 1))))

        def cell(qpdf: pd.DataFrame, bpdf: pd.DataFrame) -> pd.DataFrame:
            if len(qpdf) == 0 or len(bpdf) == 0:
                return pd.DataFrame({f.name: [] for f in cand_schema.fields})
            qm = _stack(qpdf["q_vec"].to_numpy(), dim)
            qids = qpdf["q_id"].to_numpy(dtype=np.int64)
            bm = _stack(bpdf["b_vec"].to_numpy(), dim)
            bids = bpdf["b_id"].to_numpy(dtype=np.int64)
            frames = []
            groups = bpdf["grp"].to_numpy() if group else None
            for g in (pd.unique(groups) if group else [None]):
                sel = np.arange(len(bids)) if g is None else np.nonzero(groups == g)[0]
                for start in range(0, len(sel), B_BLOCK):
                    part = sel[start:start + B_BLOCK]
                    a, b, s = _partial_topk(qm, qids, bm[part], bids[part], k, metric, exclude_self)
                    f = pd.DataFrame({"q_id": a, "b_id": b, "score": s})
                    if group:
                        f["grp"] = g
                    frames.append(f)
            out = pd.concat(frames) if frames else pd.DataFrame({"q_id": [], "b_id": [], "score": []})
            return out[[f.name for f in cand_schema.fields]]

        cands = (qx.groupBy("qb", "bb").cogroup(bx.groupBy("qb", "bb"))
                 .applyInPandas(cell, cand_schema))

    part_cols = ["q_id"] + (["grp"] if group else [])
    w = Window.partitionBy(*part_cols).orderBy(F.col("score").asc(), F.col("b_id").asc())
    ranked = cands.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    if metric == "cosine":
        ranked = ranked.withColumn("score", -F.col("score"))
    if group:
        ranked = ranked.withColumnRenamed("grp", group)
    return ranked


def _cell_stars(ids_a, ma, ids_b, mb, radius):
    """Connected components of the radius graph inside one block pair, as
    (node, representative) star edges: at most |a| + |b| rows, never the
    pairs themselves. Distances and labels are held for some rows at a time."""
    if len(ids_a) == 0 or len(ids_b) == 0:
        return [], []
    step = max(1, _SCORES // len(ids_b))
    adj = np.empty((len(ids_a), len(ids_b)), bool)
    for s in range(0, len(ma), step):
        some = ma[s:s + step]
        d, error = _approximate(some, mb, "l2")
        part = d <= radius
        # exact check of the entries that rounding may have put on either side
        i, j = np.nonzero(np.abs(d - radius) <= error[:, None])
        for a in range(0, len(i), _PAIR_CHUNK):
            x, y = i[a:a + _PAIR_CHUNK], j[a:a + _PAIR_CHUNK]
            part[x, y] = _exact_pairs(some[x], mb[y], "l2") <= radius
        adj[s:s + step] = part
    has_a, has_b = adj.any(1), adj.any(0)
    if not (has_a.all() and has_b.all()):
        adj = adj[has_a][:, has_b]
    ids_a, ids_b = ids_a[has_a].astype(np.int64), ids_b[has_b].astype(np.int64)
    la, lb = ids_a.copy(), ids_b.copy()
    big = np.iinfo(np.int64).max
    while True:
        na, nb = la.copy(), lb.copy()
        for s in range(0, len(la), step):
            nb = np.minimum(nb, np.where(adj[s:s + step], la[s:s + step, None], big).min(0))
        for s in range(0, len(la), step):
            na[s:s + step] = np.minimum(la[s:s + step], np.where(adj[s:s + step], nb[None, :], big).min(1))
        if np.array_equal(na, la) and np.array_equal(nb, lb):
            break
        la, lb = na, nb
    nodes, reps = np.concatenate([ids_a, ids_b]), np.concatenate([la, lb])
    keep = nodes != reps
    return nodes[keep].tolist(), reps[keep].tolist()


def block_pairs(vs: DataFrame, nb: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of the block pairs ``(qb, bb)`` with ``qb <= bb`` of rows
    with an ``id``: a link is found from one of its ends."""
    own = F.pmod(F.xxhash64("id"), F.lit(nb)).cast("int")
    return (vs.withColumn("qb", own).withColumn("bb", F.explode(F.sequence(F.col("qb"), F.lit(nb - 1)))),
            vs.withColumn("bb", own).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("bb")))))


def radius_components_edges(vectors: DataFrame, radius: float, *, id_col: str, vec_col: str,
                            block: int | None = None) -> DataFrame:
    """Star edges ``(src, dst)`` whose connected components equal those of
    the graph linking vectors within squared L2 ``radius``. Vectors are
    hashed into blocks; every unordered block pair is one cogroup cell that
    emits only a spanning star per local component, so output stays linear per
    cell. All pairs are compared: a vector is shipped to every block, of which
    there are about 16, more where a block would exceed ``STAR_BLOCK`` rows."""
    vs = vectors.select(F.col(id_col).cast("long").alias("id"),
                        wire(vectors, vec_col).alias("v")).filter(F.col("v").isNotNull())
    n = vs.count()
    nb = max(1, math.ceil(n / (block or min(STAR_BLOCK, max(STAR_BLOCK // 4, math.ceil(n / 16))))))
    a, b = block_pairs(vs, nb)
    schema = "src long, dst long"

    def cell(pa_df: pd.DataFrame, pb_df: pd.DataFrame) -> pd.DataFrame:
        if len(pa_df) == 0 or len(pb_df) == 0:
            return pd.DataFrame({"src": [], "dst": []})
        ma = np.stack(pa_df["v"].to_numpy()).astype(np.float64)
        mb = np.stack(pb_df["v"].to_numpy()).astype(np.float64)
        s, d = _cell_stars(pa_df["id"].to_numpy(dtype=np.int64), ma,
                           pb_df["id"].to_numpy(dtype=np.int64), mb, radius)
        return pd.DataFrame({"src": s, "dst": d}, dtype="int64")

    return (a.groupBy("qb", "bb").cogroup(b.groupBy("qb", "bb")).applyInPandas(cell, schema)
            .distinct())


def knn_routed(queries: DataFrame, base: DataFrame, routes: DataFrame, k: int, *, q_id: str,
               q_vec: str, b_id: str, b_vec: str, group: str, metric: str = "l2",
               per_group: bool = False, base_block: int = B_BLOCK,
               query_block: int = Q_BLOCK) -> DataFrame:
    """Exact top-``k`` of the base rows whose ``group`` is routed to each query
    (``routes``: ``(q_id, group)`` pairs); with ``per_group`` the top-k is kept
    per (query, group), otherwise over all routed groups.

    Only routed pairs are scored. Work is cut into cogroup cells keyed by
    (group, base sub-block, query sub-block): a group with ``n`` base rows
    gets ``ceil(n / base_block)`` sub-blocks and its routed queries
    ``ceil(m / query_block)`` sub-blocks, both from per-group counts, so a hot
    group is spread over many tasks and no cell grows with the data."""
    qs = queries.select(F.col(q_id).cast("long").alias("q_id"), wire(queries, q_vec).alias("q_vec"))
    bs = base.select(F.col(b_id).cast("long").alias("b_id"), wire(base, b_vec).alias("b_vec"),
                     F.col(group).alias("grp")).filter(F.col("b_vec").isNotNull())
    rt = routes.select(F.col(q_id).cast("long").alias("q_id"), F.col(group).alias("grp")).distinct()
    grp_type = base.schema[group].dataType
    bcount = bs.groupBy("grp").agg(F.count(F.lit(1)).alias("nb"))
    qcount = rt.groupBy("grp").agg(F.count(F.lit(1)).alias("nq"))
    sizes = (bcount.join(qcount, "grp")
             .select("grp", F.ceil(F.col("nb") / base_block).cast("int").alias("n_sub"),
                     F.ceil(F.col("nq") / query_block).cast("int").alias("n_qb")))
    b2 = (bs.join(sizes, "grp")
          .withColumn("sub", F.pmod(F.xxhash64("b_id"), F.col("n_sub")).cast("int"))
          .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("n_qb") - 1))))
    q2 = (rt.join(sizes, "grp").join(qs, "q_id")
          .withColumn("qb", F.pmod(F.xxhash64("q_id"), F.col("n_qb")).cast("int"))
          .withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("n_sub") - 1))))
    schema = T.StructType([T.StructField("q_id", T.LongType()), T.StructField("b_id", T.LongType()),
                           T.StructField("grp", grp_type), T.StructField("score", T.DoubleType())])

    def cell(qpdf: pd.DataFrame, bpdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) == 0 or len(bpdf) == 0:
            return pd.DataFrame({f.name: [] for f in schema.fields})
        dim = len(qpdf["q_vec"].iloc[0])
        qm, bm = _stack(qpdf["q_vec"].to_numpy(), dim), _stack(bpdf["b_vec"].to_numpy(), dim)
        a, b, s = _partial_topk(qm, qpdf["q_id"].to_numpy(dtype=np.int64), bm,
                                bpdf["b_id"].to_numpy(dtype=np.int64), k, metric, False)
        out = pd.DataFrame({"q_id": a, "b_id": b, "score": s})
        out["grp"] = bpdf["grp"].iloc[0]
        return out[["q_id", "b_id", "grp", "score"]]

    cands = (q2.select("grp", "sub", "qb", "q_id", "q_vec").groupBy("grp", "sub", "qb")
             .cogroup(b2.select("grp", "sub", "qb", "b_id", "b_vec").groupBy("grp", "sub", "qb"))
             .applyInPandas(cell, schema))
    part = ["q_id", "grp"] if per_group else ["q_id"]
    w = Window.partitionBy(*part).orderBy(F.col("score").asc(), F.col("b_id").asc())
    ranked = cands.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    if metric == "cosine":
        ranked = ranked.withColumn("score", -F.col("score"))
    return ranked.withColumnRenamed("grp", group)
