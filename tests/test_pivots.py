"""Pivot search: the rows of a plain search, and fewer cells than all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.plans import pivots as P
from docweave.plans.topk import knn


def _frame(spark, m):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "q_id long, q_vec array<double>").repartition(4)


def _plain(q, b, k, same):
    out = set()
    for i, v in enumerate(q):
        d = [(float(((v - w) ** 2).sum()), j) for j, w in enumerate(b) if not (same and i == j)]
        out |= {(i, j, r + 1) for r, (_, j) in enumerate(sorted(d)[:k])}
    return out


def _clusters(rng, n, dim=8):
    centres = rng.normal(size=(40, dim)) * 20
    return centres[rng.integers(0, 40, n)] + rng.normal(size=(n, dim))


@pytest.mark.parametrize("same", [True, False])
def test_same_rows_as_a_plain_search(spark, same):
    rng = np.random.default_rng(1)
    m = np.round(_clusters(rng, 300), 2)
    m[50:90] = m[50]  # copies
    m[7] = 1e6
    q = m if same else np.round(_clusters(rng, 60), 2)
    df, qs = _frame(spark, m), _frame(spark, q)
    cells = P.PivotCells(df, "q_id", "q_vec", 8, block=16)
    got = P.pivot_knn(qs, cells, 5, exclude_self=same)
    assert {(r["q_id"], r["b_id"], r["rank"]) for r in got.collect()} == _plain(q, m, 5, same)
    wide = knn(qs, df, 5, q_id="q_id", q_vec="q_vec", b_id="q_id", b_vec="q_vec", exclude_self=same, max_broadcast_bytes=0)
    assert {(r["q_id"], r["b_id"], r["rank"]) for r in wide.collect()} == _plain(q, m, 5, same)


def test_fewer_rows_than_asked_and_none(spark):
    m = np.arange(12.0).reshape(3, 4)
    df = _frame(spark, m)
    cells = P.PivotCells(df, "q_id", "q_vec", 4)
    assert P.pivot_knn(df, cells, 9, exclude_self=True).count() == 6
    none = P.PivotCells(df.limit(0), "q_id", "q_vec", 4)
    assert P.pivot_knn(df, none, 2).count() == 0 and P.pivot_knn(df.limit(0), cells, 2).count() == 0


def test_visits_grow_slower_than_the_square(spark):
    seen = {}
    for n in (500, 4000):
        m = _clusters(np.random.default_rng(2), n)
        df = _frame(spark, m)
        counts: list[int] = []
        cells = P.PivotCells(df, "q_id", "q_vec", 8)
        P.pivot_knn(df, cells, 5, exclude_self=True, counts=counts).count()
        rows = {r["cell"]: r["n"] for r in cells.rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        seen[n] = sum(counts) * sum(rows.values()) / len(rows)  # vectors compared
    assert seen[4000] < 8 ** 2 / 2 * seen[500] and seen[4000] < 0.25 * 4000 ** 2


def test_a_cell_that_all_visit_is_split(spark, monkeypatch):
    monkeypatch.setattr(P, "QUERY_BLOCK", 20)
    m = np.concatenate([np.zeros((200, 3)), np.eye(3)])
    df = _frame(spark, m)
    cells = P.PivotCells(df, "q_id", "q_vec", 3, block=50)
    got = P.pivot_knn(df, cells, 2, exclude_self=True)
    assert {(r["q_id"], r["b_id"], r["rank"]) for r in got.collect()} == _plain(m, m, 2, True)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_blocks_where_no_cell_can_be_excluded(spark, monkeypatch, kind):
    monkeypatch.setattr(P, "QUERY_BLOCK", 100)
    monkeypatch.setattr(P, "CELL_BLOCK", 60)
    m = np.random.default_rng(3).normal(size=(400, 24)).astype(np.float32)
    m[30:40] = m[30]
    df = _frame(spark, m).withColumn("q_vec", F.col("q_vec").cast(f"array<{kind}>"))
    cells = P.PivotCells(df, "q_id", "q_vec", 24)
    assert cells.rows.schema["v"].dataType.elementType.simpleString() == kind
    counts: list[int] = []
    got = P.pivot_knn(df, cells, 3, exclude_self=True, counts=counts).collect()
    assert counts[1] == 400 * 2  # rows of two blocks, not of some twenty cells
    assert {(r["q_id"], r["b_id"], r["rank"]) for r in got} == _plain(m.astype(np.float64), m.astype(np.float64), 3, True)


def test_a_query_is_shipped_to_its_cells_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(P, "SENT_BYTES", 8 * 8 * 16)
    monkeypatch.setattr(P, "CELL_BLOCK", 1 << 20)
    m = np.round(_clusters(np.random.default_rng(4), 300), 2)
    df = _frame(spark, m)
    got = P.pivot_knn(df, P.PivotCells(df, "q_id", "q_vec", 8, block=16), 5, exclude_self=True)
    assert {(r["q_id"], r["b_id"], r["rank"]) for r in got.collect()} == _plain(m, m, 5, True)
