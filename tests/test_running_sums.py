"""Bandwidth searches by streams of others, and neighbours looked for within regimes."""

import math

import numpy as np

from terrane.operators import local, running
from terrane.operators.search import curve


def table(spark, n, seed=4, columns=25):
    draw = np.random.default_rng(seed)
    rows = [(i, float(i % columns), float(i // columns), float(draw.normal()), 1.0, float(draw.normal()), int(draw.integers(1, 4))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, px double, py double, yy double, x0 double, x1 double, regime long")


def plain(rows, k, within=False, mask=False, factor=1.0):
    """rss and trace at k neighbours, infinite where a row can't be told."""
    a = np.array(rows, float)
    rss = trace = 0.0
    for f in a:
        own = a[a[:, 6] == f[6]] if within else a
        d2 = ((own[:, 1:3] - f[1:3]) ** 2).sum(1)
        order = np.lexsort((own[:, 0], d2))[:k]
        own, d2 = own[order], d2[order]
        w = (1 - d2 / (d2[-1] * factor)) ** 2
        w = w * (own[:, 6] == f[6]) if mask else w
        x = own[:, 4:6]
        m = (x * w[:, None]).T @ x
        if (mask and (own[:, 6] == f[6]).sum() < 2) or np.linalg.eigvalsh(m)[0] < 1e-12:
            return math.inf, math.inf
        s = np.linalg.solve(m, np.stack([(x * w[:, None]).T @ own[:, 3], f[4:6]], 1))
        rss, trace = rss + (f[3] - f[4:6] @ s[:, 0]) ** 2, trace + f[4:6] @ s[:, 1]
    return rss, trace


def test_every_number_is_scored_over_rings(spark, monkeypatch):
    monkeypatch.setattr(running, "RING", 50)  # many rings a row
    rows, obs = table(spark, 300)
    for how in ({}, {"mask": "regime"}):
        got = {r.k: r for r in curve(obs, 8, 300, **how).collect()}
        assert sorted(got) == list(range(8, 301))
        for k in (8, 20, 31, 150, 299, 300):
            rss, trace = plain(rows, k, mask="mask" in how)
            assert math.isinf(got[k].rss) if math.isinf(rss) else np.isclose(got[k].rss, rss, rtol=1e-8) and np.isclose(got[k].trace, trace, rtol=1e-8)
    found = {k: curve(obs, 30, k).where("k = 30").first() for k in (31, 300)}  # by nearest rows, and by rings
    assert np.isclose(found[31].rss, found[300].rss) and np.isclose(found[31].aicc, found[300].aicc)


def test_what_a_search_shuffles_are_blocks_and_others(spark):
    _, obs = table(spark, 1000)
    plan = running.scored(obs, 2, 8, 1000, 1000)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan  # no table of pairs is sorted
    placed = running.in_blocks(obs, 64, 1000)
    assert placed.count() == 1000 and 16 <= placed.select("block").distinct().count() <= 32
    assert placed.groupBy("block").count().where("count > 64").isEmpty()


def test_neighbours_of_a_regime_are_looked_for_near(spark):
    rows, obs = table(spark, 2500)
    sizes = local.regime_sizes(obs, {1: 10, 2: 20, 3: 5}).select("regime", "k")
    near = local.pairs(obs, within="regime", nearest=sizes)
    assert near.count() < 2500 * 2500 / 3 / 4  # all pairs of a regime are 2500 * 2500 / 3
    got = {r.id: r for r in local.regime_fit(obs, {1: 10, 2: 20, 3: 5}).collect()}
    a = np.array(rows, float)
    for f in a[::97]:
        own = a[a[:, 6] == f[6]]
        d2 = ((own[:, 1:3] - f[1:3]) ** 2).sum(1)
        b2 = np.sort(d2)[{1: 10, 2: 20, 3: 5}[int(f[6])] - 1]
        w = np.where(d2 < b2, (1 - d2 / b2) ** 2, 0)
        m = (own[:, 4:6] * w[:, None]).T @ own[:, 4:6]
        b = np.linalg.solve(m, (own[:, 4:6] * w[:, None]).T @ own[:, 3])
        assert np.allclose([got[int(f[0])].b0, got[int(f[0])].b1], b, rtol=1e-6)
