"""Local fits by whole cells against those by pairs."""

import random

import pytest
from pyspark.sql import functions as F

from terrane.operators import cells, local

SCHEMA = "id long, px double, py double, yy double, x0 double, x1 double"


def rows(n, seed, place):
    rng = random.Random(seed)
    return [(i, *place(rng, i), rng.gauss(0, 1), 1.0, rng.gauss(0, 1)) for i in range(n)]


EVEN = lambda rng, i: (rng.uniform(0, 100) + 5e4, rng.uniform(0, 40) - 3e4)
CROWDED = lambda rng, i: (rng.uniform(0, 1), rng.uniform(0, 1)) if i % 10 else (rng.uniform(0, 300), rng.uniform(0, 300))
LATTICE = lambda rng, i: (float(i % 17), float(i // 17))
FEW = lambda rng, i: (float(i % 3), 0.0)
ONE = lambda rng, i: (2.0, 3.0)


def compared(spark, data, bandwidth, **how):
    obs = spark.createDataFrame(data, SCHEMA).repartition(3)
    kernel = {key: v for key, v in how.items() if key != "leaf"}
    got = {r.id: r for r in cells.far_fit(obs, bandwidth, **how).collect()}
    want = {r.id: r for r in local.local_fit(obs, bandwidth, far=False, **kernel).collect()}
    assert set(got) == set(want) and len(got) == len(data)
    for i, r in want.items():
        for c in ("b0", "b1", "fitted", "resid", "hat"):
            assert got[i][c] == pytest.approx(r[c], rel=1e-7, abs=1e-8, nan_ok=True), (i, c)


@pytest.mark.parametrize("place, n, k", [(EVEN, 700, 175), (CROWDED, 600, 150), (EVEN, 100, 100), (FEW, 200, 150)])
def test_bandwidths_by_count(spark, place, n, k):
    compared(spark, rows(n, n, place), k)


def test_a_bandwidth_of_nothing_is_the_least_distance(spark):
    data = rows(200, 3, lambda rng, i: (5.0, 5.0) if i < 120 else (rng.uniform(0, 50), rng.uniform(0, 50)))
    compared(spark, data, 60)
    compared(spark, rows(40, 4, ONE), 10)


def test_bandwidths_by_distance_and_boundary(spark):
    compared(spark, rows(500, 5, EVEN), 25.0)
    compared(spark, rows(500, 6, CROWDED), 40.0, strict=True)
    compared(spark, rows(400, 7, LATTICE), 100, boundary="factor")
    compared(spark, rows(400, 8, LATTICE), 7.0, leaf=1)


def test_empty_tables_and_rows_without_a_place(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert cells.far_fit(none, 5).collect() == [] and cells.far_fit(none, 5).columns == local.local_fit(none, 5, far=False).columns
    data = rows(50, 9, EVEN)
    obs = spark.createDataFrame([*data, (99, None, 1.0, 1.0, 1.0, 1.0)], SCHEMA)
    assert sorted(r.id for r in cells.far_fit(obs, 20).collect()) == list(range(50))


def test_rows_meet_few_others(spark):
    """Each row is within, at the rim or beyond, once; and the pairs at the rim grow with the edge of the disc."""
    obs = spark.createDataFrame(rows(3000, 10, EVEN), SCHEMA)
    placed, nodes = cells.tree(obs)
    inside, rim = cells.descended(nodes, 1500)
    size = nodes.select("cell", "n")
    at_rim = rim.join(size.toDF("f", "fn"), "f").join(size.toDF("c", "cn"), "c").agg(F.sum(F.col("fn") * F.col("cn"))).first()[0]
    assert at_rim < 0.5 * 3000 * 1500 and inside.count() > 0
    assert rim.select("f").distinct().count() == nodes.where("is_leaf").count()
