"""op 12 against brute force: clusters, ties, repeats, odd rows; bounds hold; few rows are scored where vectors form clusters."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulefact.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, block string, q int"


def brute(rows, modulus=50, positives=5, negatives_=3):
    seen = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        seen[i, label, tuple(math.floor(256 * x) for x in v)] = None
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in seen:
        if a[0] % modulus:
            continue
        others = sorted((-dot(a[2], b[2]), b[0], b[1]) for b in seen if b != a)
        for ps, pid, _ in [x for x in others if x[2] == a[1]][:positives]:
            band = [(-s, i) for s, i, label in others if label != a[1] and 50 * -ps <= 100 * -s <= 95 * -ps]
            out += [(a[0], pid, r, i, -ps, s) for r, (s, i) in enumerate(band[:negatives_], 1)]
    return sorted(out)


def made(n=900, width=12, seed=3):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((9, width))
    x = centres[r.integers(0, 9, n)] + 0.4 * r.standard_normal((n, width))
    rows = [(k, [float(y) for y in x[k] * (1 + k % 3)], int(r.integers(0, 4)), "x", 1) for k in range(n)]
    rows[100:140] = [(100 + k, rows[0][1], k % 3, None, None) for k in range(40)]  # ties
    rows += rows[150:152] + [(350, rows[5][1], 2, "x", 1), (350, rows[6][1], 2, "x", 1), (400, [0.0] * width, 1, "x", 1), (450, [], 2, "x", 1), (500, rows[7][1] + [3.0, 1.0], 3, "x", 1)]
    rows += [(None, rows[1][1], 1, "x", 1), (550, None, 1, "x", 1), (600, rows[1][1], None, "x", 1), (650, [1.0, None], 1, "x", 1), (700, [float("nan")] * width, 1, "x", 1), (750, [float("inf")] * width, 1, "x", 1), (-50, rows[3][1], 2, "x", 1)]
    return rows


def run(df, **how):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(x) for x in negatives.hard_negatives(df, label, **how).collect())


@pytest.mark.parametrize("group_rows", [4096, 70])
def test_equals_brute_force(spark, monkeypatch, group_rows):
    monkeypatch.setattr(negatives, "GROUP_ROWS", group_rows)
    rows = made()
    assert run(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_small_tables(spark):
    few = spark.createDataFrame(made(60)[:7], SCHEMA)
    assert run(few.limit(0)) == [] and run(few.where("vec_id % 50 <> 0")) == []
    assert run(few) == brute(made(60)[:7])
    alike = [(k, [1.0, 2.0], 1, None, None) for k in range(0, 200, 25)]
    assert run(spark.createDataFrame(alike, SCHEMA)) == brute(alike) == []
    with pytest.raises(Exception, match="too large"):
        run(spark.createDataFrame([(0, [1e300], 1, None, None), (1, [1e300], 1, None, None)], SCHEMA))


def test_large_components_are_exact(spark):
    rows = [(k, [float(random.Random(k).randrange(1 << 21)), float(k)], k % 2, None, None) for k in range(120)]
    assert run(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_bounds_hold():
    r = np.random.default_rng(8)
    for width in (1, 2, 7, 30):
        x, a, d = (np.round(r.standard_normal((n, width)) * 100) for n in (200, 40, 6))
        x[:3] = 0
        x[3:6] = -a[:3]
        x[6:9] = a[:3] * 2
        d = d / np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1)
        tx, ta, nx, na = negatives._angles(x, d), negatives._angles(a, d), np.linalg.norm(x, axis=1), np.linalg.norm(a, axis=1)
        low, high = negatives._bounds(ta, na, tx, tx, nx, nx)
        assert (low <= a @ x.T).all() and (a @ x.T <= high).all()
        s = np.arange(0, 200, 8)
        low, high = negatives._bounds(ta, na, np.minimum.reduceat(tx, s), np.maximum.reduceat(tx, s), np.minimum.reduceat(nx, s), np.maximum.reduceat(nx, s))
        product = a @ x.T
        assert (low <= np.minimum.reduceat(product, s, axis=1)).all() and (np.maximum.reduceat(product, s, axis=1) <= high).all()


def test_clusters_are_skipped():
    """Of rows in tight clusters, in order of their nearest direction, an anchor's window overlaps few strips."""
    r = np.random.default_rng(2)
    centres = r.standard_normal((16, 32)) * 100
    x = np.round(np.repeat(centres, 64, axis=0) + r.standard_normal((1024, 32)))
    d = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    t, n = negatives._angles(x, d), np.linalg.norm(x, axis=1)
    s = np.arange(0, 1024, 32)
    a = x[::64]
    _, high = negatives._bounds(t[::64], n[::64], np.minimum.reduceat(t, s), np.maximum.reduceat(t, s), np.minimum.reduceat(n, s), np.maximum.reduceat(n, s))
    fifth = -np.sort(-(a @ x.T), axis=1)[:, 5]
    assert (high >= fifth[:, None]).mean() < 0.2
