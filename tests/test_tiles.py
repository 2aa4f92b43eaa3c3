"""Sums over all rows, block by block."""

import numpy as np
from pyspark.sql import functions as F

from terrane.operators import local, tiles


def test_blocks_meet_as_all_pairs_do(spark):
    draw = np.random.default_rng(6)
    xy, x, y = draw.normal(0, 40, (700, 2)), draw.normal(size=700), draw.normal(size=700)
    xy[5] = xy[6]
    obs = spark.createDataFrame([(i, *map(float, xy[i]), float(y[i]), 1.0, float(x[i])) for i in range(700)], "id long, px double, py double, yy double, x0 double, x1 double")
    d2 = ((xy[:, None] - xy[None]) ** 2).sum(2)
    got = {r.i: r for r in tiles.distances_of(obs).collect()}
    for i in range(700):
        assert got[i].n == 700 and np.allclose([got[i].d_min, got[i].d_max, got[i].d_mean], [np.sqrt(d2[i][d2[i] > 0].min()), np.sqrt(d2[i].max()), np.sqrt(d2[i]).mean()])
    for kernel, w in (("gaussian", np.exp(-0.5 * d2 / 0.25)), ("exponential", np.exp(-np.sqrt(d2) / 0.5)), ("bisquare", np.where(d2 < 0.25, (1 - d2 / 0.25) ** 2, 0))):
        sums = {r.i: r.w for r in tiles.weight_sums(obs, 0.5, kernel).collect()}
        assert np.allclose([sums[i] for i in range(700)], w.sum(1), rtol=1e-12)
    fit = {r.id: r for r in local.local_fit(obs, 9.0, "gaussian").collect()}
    t = np.stack([np.ones(700), x], 1)
    for i in range(0, 700, 50):
        m = t * np.exp(-0.5 * d2[i] / 81)[:, None]
        assert np.allclose([fit[i].b0, fit[i].b1], np.linalg.solve(m.T @ t, m.T @ y))


def test_no_table_of_pairs_is_made(spark):
    obs = spark.range(700).select("id", F.col("id").cast("double").alias("px"), F.lit(0.0).alias("py"), F.lit(1.0).alias("yy"), F.lit(1.0).alias("x0"))
    plan = local.local_fit(obs, 9.0, "gaussian")._jdf.queryExecution().optimizedPlan().toString()
    assert "a_block" in plan and "f_px" not in plan  # blocks are joined, not rows
    assert tiles.end_of(6.0, "gaussian") < 232 and np.exp(-0.5 * (tiles.end_of(6.0, "gaussian") / 6) ** 2) == 0.0
