"""Nearest entities against all pairs."""

import numpy as np

from rulefact.operators import nearest as N


def clustered(n, seed=3, dim=32):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(max(4, n // 100), dim))
    return centres[g.integers(len(centres), size=n)] + 0.25 * g.normal(size=(n, dim))


def frame(spark, x):
    return spark.createDataFrame([(k, [float(y) for y in v]) for k, v in enumerate(x)], "id long, v array<double>").repartition(4)


def exact(x, ids, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = np.round(u[ids] @ u.T, 9)
    c[np.arange(len(ids)), ids] = -2
    return {int(i): [int(j) for j in np.lexsort((np.arange(len(x)), -row))[:k]] for i, row in zip(ids, c)}


def found(df):
    out = {}
    for r in df.orderBy("id", "place").collect():
        out.setdefault(r.id, []).append(r.other)
    return out


def test_recall_and_share_scored(spark):
    share = {}
    for n in (2500, 20000):
        x = clustered(n)
        rows = frame(spark, x)
        got, probes = N.nearest(rows.where("id % 20 = 0"), rows, 10, leaf=64)
        got, want = found(got), exact(x, np.arange(0, n, 20), 10)
        assert got.keys() == want.keys()
        assert np.mean([len(set(got[i]) & set(want[i])) / 10 for i in want]) >= 0.9 and probes.recall >= 0.95
        share[n] = probes.tables * 2.0 ** (probes.differ - probes.bits)
    assert share[20000] < share[2500] / 2 and share[20000] < 0.2, share


def test_full_recall_is_all_pairs(spark):
    """Isotropic vectors with copies of one, and every recall up to 1: the exhaustive search, ties by id."""
    x = np.random.default_rng(5).normal(size=(600, 8))
    x[100:300] = x[100]
    rows = frame(spark, x)
    got, probes = N.nearest(rows, rows, 5, recall=1.0, leaf=100)
    if probes.differ == probes.bits:
        assert found(got) == exact(x, np.arange(600), 5)
    got, _ = N.nearest(rows.where("id % 20 = 0"), rows, 5, leaf=1000)
    assert found(got) == exact(x, np.arange(0, 600, 20), 5)


def test_defined_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1e300, 1e300]), (8, [1.0]), (9, []), (None, [1.0, 1.0])], "id long, v array<double>")
    got, _ = N.nearest(rows, rows, 2)
    assert [(r.id, r.other, round(r.cosine, 4), r.place) for r in got.orderBy("id", "place").collect()] == [(1, 8, 1.0, 1), (1, 7, 0.7071, 2), (7, 1, 0.7071, 1), (7, 8, 0.7071, 2), (8, 1, 1.0, 1), (8, 7, 0.7071, 2)]
    assert N.nearest(rows.limit(0), rows, 2)[0].count() == N.nearest(rows, rows.limit(0), 2)[0].count() == 0


def test_groups_in_pieces_change_nothing(spark, monkeypatch):
    """Codes that hold more rows, and more queries, than may meet in one task: the same neighbours, and no row for every pair."""
    x = np.random.default_rng(6).normal(size=(900, 8))
    x[200:260] = x[200] * 3
    rows = frame(spark, x)
    queries = rows.where("id % 3 = 0")
    monkeypatch.setattr(N, "PIECE", 100)
    got, _ = N.nearest(queries, rows, 5, leaf=1000)
    assert found(got) == exact(x, np.arange(0, 900, 3), 5)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan


def test_best_of_a_block_ties_to_smaller_ids():
    x, y = np.array([[1.0, 0.0], [0.0, 1.0]]), np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [1.0, 0.0]])
    q, r, c = N._best(np.array([7, 8]), x, np.array([9, 8, 3, 7]), y, 2)
    assert sorted(zip(q.tolist(), r.tolist(), c.tolist())) == [(0, 0, 1.0), (0, 2, 1.0), (1, 2, 0.0), (1, 3, 0.0)]
