"""Exact kNN: broadcast path and block-cogroup path against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.plans.topk import knn, radius_components_edges


def _brute(q, b, k, metric="l2", exclude_self=False):
    out = {}
    for qi, qv in q.items():
        scores = []
        for bi, bv in b.items():
            if exclude_self and qi == bi:
                continue
            if metric == "l2":
                s = float(((qv - bv) ** 2).sum())
            else:
                s = -float(qv @ bv / (np.linalg.norm(qv) * np.linalg.norm(bv)))
            scores.append((s, bi))
        out[qi] = [bi for _, bi in sorted(scores)[:k]]
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    base = rng.normal(size=(300, 8)).astype(np.float32)
    base[5] = base[4]  # an exact tie
    qs = rng.normal(size=(40, 8)).astype(np.float32)
    return base, qs


@pytest.mark.parametrize("bcast", [64 << 20, 0])
@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_knn_matches_brute_force(spark, data, bcast, metric):
    base, qs = data
    bdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "b_id long, b_vec array<float>")
    qdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(qs)], "q_id long, q_vec array<float>")
    got = knn(qdf, bdf, 5, metric=metric, max_broadcast_bytes=bcast).collect()
    res = {}
    for r in sorted(got, key=lambda r: (r.q_id, r["rank"])):
        res.setdefault(r.q_id, []).append(r.b_id)
    exp = _brute({i: v.astype(np.float64) for i, v in enumerate(qs)},
                 {i: v.astype(np.float64) for i, v in enumerate(base)}, 5, metric)
    assert res == exp


def test_self_knn_excludes_self_and_breaks_ties_by_id(spark, data):
    base, _ = data
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "id long, v array<float>")
    got = knn(df, df, 1, q_id="id", q_vec="v", b_id="id", b_vec="v", exclude_self=True)
    m = {r.q_id: r.b_id for r in got.collect()}
    assert m[4] == 5 and m[5] == 4


def test_grouped_knn(spark, data):
    base, qs = data
    bdf = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(base)],
                                "b_id long, b_vec array<float>, g int")
    qdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(qs[:5])], "q_id long, q_vec array<float>")
    got = knn(qdf, bdf, 2, group="g").collect()
    assert len(got) == 5 * 3 * 2
    for g in range(3):
        sub = {i: v.astype(np.float64) for i, v in enumerate(base) if i % 3 == g}
        exp = _brute({i: v.astype(np.float64) for i, v in enumerate(qs[:5])}, sub, 2)
        res = {}
        for r in sorted([r for r in got if r.g == g], key=lambda r: (r.q_id, r["rank"])):
            res.setdefault(r.q_id, []).append(r.b_id)
        assert res == exp


def test_radius_components(spark):
    pts = [(0, [0.0, 0.0]), (1, [0.5, 0.0]), (2, [1.0, 0.0]), (3, [5.0, 5.0]), (4, [5.2, 5.0]), (5, [9.0, 9.0])]
    df = spark.createDataFrame(pts, "id long, v array<double>")
    edges = radius_components_edges(df, 0.3, id_col="id", vec_col="v", block=2).collect()
    parent = {i: i for i, _ in pts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for e in edges:
        parent[find(e.src)] = find(e.dst)
    comps = {}
    for i, _ in pts:
        comps.setdefault(find(i), set()).add(i)
    assert sorted(map(sorted, comps.values())) == [[0, 1, 2], [3, 4], [5]]


def test_routed_knn_with_split_hot_group(spark, data):
    from docweave.plans.topk import knn_routed
    base, qs = data
    groups = [0 if i < 200 else 1 + i % 5 for i in range(len(base))]  # group 0 holds 2/3 of rows
    bdf = spark.createDataFrame([(i, v.tolist(), g) for i, (v, g) in enumerate(zip(base, groups))],
                                "b_id long, b_vec array<float>, g int")
    qdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(qs)], "q_id long, q_vec array<float>")
    routes_l = [(q, g) for q in range(len(qs)) for g in ([0, 1 + q % 5] if q % 2 else [2 + q % 4])]
    routes = spark.createDataFrame(routes_l, "q_id long, g int")
    for per_group in (False, True):
        got = knn_routed(qdf, bdf, routes, 3, q_id="q_id", q_vec="q_vec", b_id="b_id", b_vec="b_vec",
                         group="g", per_group=per_group, base_block=17, query_block=4).collect()
        res = {}
        for r in sorted(got, key=lambda r: (r.q_id, r.g if per_group else 0, r["rank"])):
            res.setdefault((r.q_id, r.g) if per_group else r.q_id, []).append(r.b_id)
        for q in range(len(qs)):
            gs = [g for qq, g in routes_l if qq == q]
            if per_group:
                for g in gs:
                    sub = {i: v.astype(np.float64) for i, v in enumerate(base) if groups[i] == g}
                    assert res[(q, g)] == _brute({q: qs[q].astype(np.float64)}, sub, 3)[q]
            else:
                sub = {i: v.astype(np.float64) for i, v in enumerate(base) if groups[i] in gs}
                assert res[q] == _brute({q: qs[q].astype(np.float64)}, sub, 3)[q]


@pytest.mark.parametrize("bcast", [64 << 20, 0])
def test_copies_offset_and_error_bound(spark, bcast):
    """More copies than any fixed margin, and a large common offset."""
    rng = np.random.default_rng(11)
    copies = [(i, [1.0, 2.0]) for i in range(50)] + [(60 + i, [5.0, float(i)]) for i in range(10)]
    df = spark.createDataFrame(copies, "id long, v array<double>").repartition(4)
    one = spark.createDataFrame([(-1, [1.0, 2.0])], "id long, v array<double>")
    got = knn(one, df, 3, q_id="id", q_vec="v", b_id="id", b_vec="v", max_broadcast_bytes=bcast).orderBy("rank").collect()
    assert [r.b_id for r in got] == [0, 1, 2]
    far = 1e6 + 0.01 * rng.normal(size=(500, 8))
    fdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(far)], "id long, v array<double>")
    hits = knn(fdf, fdf, 5, q_id="id", q_vec="v", b_id="id", b_vec="v", exclude_self=True, max_broadcast_bytes=bcast).collect()
    res = {}
    for r in sorted(hits, key=lambda r: (r.q_id, r["rank"])):
        res.setdefault(r.q_id, []).append(r.b_id)
    vecs = dict(enumerate(far))
    assert res == _brute(vecs, vecs, 5, exclude_self=True)


def test_odd_vectors_are_never_dropped_silently(spark):
    from docweave.plans.topk import vector_status
    ok = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "id long, v array<double>")
    for bad in ([1.0], [1.0, 2.0, 3.0], [1.0, float("nan")], [1.0, float("inf")]):
        odd = spark.createDataFrame([(1, [1.0, 2.0]), (3, bad)], "id long, v array<double>")
        for q, b in ((ok, odd), (odd, ok)):
            with pytest.raises(Exception, match="values|finite"):
                knn(q, b, 1, q_id="id", q_vec="v", b_id="id", b_vec="v", dim=2).collect()
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [float("nan"), 0.0])]
    status = vector_status(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 2).collect()
    assert {(r.id, r.status) for r in status} == {(2, "null"), (3, "size"), (4, "not_finite")}



def test_candidates_come_a_slice_of_queries_at_a_time(monkeypatch):
    from docweave.plans import topk
    monkeypatch.setattr(topk, "_SCORES", 300 * 10)
    m = np.random.default_rng(5).normal(size=(300, 6))
    ids = np.arange(300)
    parts = list(topk._best_slices(m, ids, m, ids, 4, "l2", True))
    assert len(parts) == 30 and all(len(p[0]) == 40 and isinstance(p[0], np.ndarray) for p in parts)
    got = {}
    for q, b in zip(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])):
        got.setdefault(int(q), []).append(int(b))
    assert got == _brute(dict(enumerate(m)), dict(enumerate(m)), 4, exclude_self=True)


def test_each_pair_of_blocks_meets_once(spark, monkeypatch):
    from docweave.operators.topics import connected_components
    from docweave.plans import topk
    monkeypatch.setattr(topk, "_SCORES", 64)
    m = np.random.default_rng(6).normal(size=(120, 2)).astype(np.float32)
    vs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<float>")
    a, b = topk.block_pairs(vs.select("id"), 6)
    assert a.count() + b.count() == 120 * 7  # not 120 * 12
    assert a.filter("qb > bb").isEmpty() and b.filter("qb > bb").isEmpty()
    edges = radius_components_edges(vs, 0.02, id_col="id", vec_col="v", block=20)
    got = {r["id"]: r["comp"] for r in connected_components(vs.select("id"), edges).collect()}
    w = m.astype(np.float64)
    near = ((w[:, None] - w[None]) ** 2).sum(2) <= 0.02
    comp = np.arange(120)
    for _ in range(120):
        comp = np.where(near, comp[None, :], 120).min(1)
    assert got == dict(enumerate(comp.tolist())) and len(set(got.values())) < 120
