"""Neighbour joins where points crowd, and fits by moments of coordinates."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import graph, local


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, px double, py double").repartition(3)


def crowded(n, seed, wide=200.0):
    rng = random.Random(seed)
    return [(i, *((rng.uniform(0, 1), rng.uniform(0, 1)) if i % 20 else (rng.uniform(0, wide), rng.uniform(0, wide)))) for i in range(n)]


def plain_edges(rows, k):
    xy = np.array([r[1:] for r in rows])
    ids = [r[0] for r in rows]
    out = set()
    for a, i in enumerate(ids):
        d = ((xy - xy[a]) ** 2).sum(1)
        for j in sorted((x for x in range(len(ids)) if x != a), key=lambda x: (d[x], ids[x]))[:k]:
            out.add((min(i, ids[j]), max(i, ids[j])))
    return out


@pytest.mark.parametrize("make", [lambda: crowded(600, 1), lambda: crowded(600, 2, 1e6), lambda: [(i, float(i % 3), 0.0) for i in range(400)], lambda: [(i, 5.0, 5.0) for i in range(300)], lambda: crowded(500, 3) + [(1000 + i, 0.5, 0.5) for i in range(200)]])
def test_nearest_edges_of_crowded_points(spark, make):
    rows = make()
    got = {(r.i, r.j) for r in graph.nearest_edges(table(spark, rows), 5).collect()}
    assert got == plain_edges(rows, 5)


def test_pairs_a_point_are_bounded_where_points_crowd(spark):
    k = 8
    rows = crowded(6000, 4)
    points = table(spark, rows)
    focal = points.select(F.col("id").alias("i"), F.col("px").alias("f_px"), F.col("py").alias("f_py"))
    other = points.select(F.col("id").alias("j"), "px", "py")
    pairs = local.near_pairs(focal, other, k, points).count()
    assert k <= pairs / len(rows) <= 10 * k
    same = table(spark, [(i, 1.0, 2.0) for i in range(5000)] + [(5000 + i, float(i), 7.0) for i in range(500)])
    plan = graph.nearest_edges(same, k)
    assert plan.count() <= 5500 * k


def brute(rows, target, least, own_only=False):
    """Residuals of fits to one regime with bisquare weights out to its farthest row."""
    out = {}
    for i, px, py, y, x, g in rows:
        others = [r for r in rows if r[5] == target and (own_only or r[0] != i)]
        if not others or own_only and g != target:
            continue
        d = np.array([math.hypot(px - r[1], py - r[2]) for r in others])
        b = d.max() if d.max() > 1e-12 else 1.0
        w = np.where(d < b, (1 - (d / b) ** 2) ** 2, 0.0)
        m = np.array([[1.0, r[4]] for r in others])
        beta = np.linalg.lstsq(m * np.sqrt(w)[:, None], np.array([r[3] for r in others]) * np.sqrt(w), rcond=None)[0]
        out[i] = (y - beta[0] - beta[1] * x, len(others))
    return out


def regimes(spark, seed=7):
    rng = random.Random(seed)
    rows = []
    for i in range(240):
        g = i % 4
        rows.append((i, 1e4 * g + rng.gauss(0, 10.0 ** (g - 1)), -3e3 * g + rng.gauss(0, 5), rng.gauss(0, 1), rng.gauss(0, 1), g))
    rows.append((999, 5.0, 5.0, 1.0, 2.0, 9))  # a regime of one
    return rows, spark.createDataFrame(rows, "id long, px double, py double, yy double, x1 double, regime long").withColumn("x0", F.lit(1.0))


def test_left_out_errors_by_moments(spark):
    rows, obs = regimes(spark)
    obs = obs.repartition(3)
    got = {(r.id, r.target): (r.error, r.n) for r in local.left_out_error(obs, 5).collect()}
    want = {(i, t): v for t in (0, 1, 2, 3, 9) for i, v in brute(rows, t, 5).items()}
    assert set(got) == set(want) and (999, 9) not in got
    for key, (resid, n) in want.items():
        error, m = got[key]
        assert m == n and (math.isinf(error) if n < 5 else error == pytest.approx(resid**2, rel=1e-5, abs=1e-9)), key


def test_fits_as_far_as_the_regime_make_no_pairs(spark):
    rows, obs = regimes(spark)
    rows, obs = [r for r in rows if r[5] != 9], obs.where("regime <> 9")
    fit = local.regime_fit(obs)
    assert "Cartesian" not in fit._jdf.queryExecution().toString() and fit.count() == len(rows)
    got = {r.id: r.resid for r in fit.collect()}
    for t in range(4):
        for i, (resid, _) in brute(rows, t, 0, True).items():
            assert got[i] == pytest.approx(resid, rel=1e-6, abs=1e-8)


def test_corners_of_points_on_circles_and_lines(spark):
    rows = [(k, "a", math.cos(k), math.sin(k)) for k in range(200)] + [(k, "b", float(k), 2.0 * k) for k in range(100)] + [(0, "c", 1.0, 1.0)] * 3
    got = {r.g: sorted((c.x, c.y) for c in r.hull) for r in local.hulls(spark.createDataFrame(rows, "id long, g string, px double, py double").repartition(4), "g").collect()}
    assert len(got["a"]) == 200 and got["b"] == [(0.0, 0.0), (99.0, 198.0)] and got["c"] == [(1.0, 1.0)]
