"""Neighbour joins and spanning trees on cells, against all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrane.operators import graph, local
from terrane.tables import shared_folder

RNG = np.random.default_rng(0)
PLACES = {
    "even": RNG.random((300, 2)),
    "clusters and far points": np.concatenate([RNG.normal(0, 1e-3, (120, 2)), RNG.normal(5, 1, (80, 2)), [[1e4, 1e4], [-3e3, 2.0]]]),
    "a lattice": np.stack([np.arange(200) % 14, np.arange(200) // 14], 1).astype(float),
    "a line": np.stack([RNG.random(200), np.zeros(200)], 1),
    "one place and others": np.concatenate([np.ones((40, 2)), RNG.random((60, 2))]),
    "few": RNG.random((12, 2)),
}


@pytest.mark.parametrize("name", PLACES)
def test_nearest_and_tree(spark, name):
    xy, k = PLACES[name], 8
    n = len(xy)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "px": xy[:, 0], "py": xy[:, 1]}))
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
    d2 = ((xy[:, None] - xy[None]) ** 2).sum(2)
    np.fill_diagonal(d2, np.inf)
    want = {tuple(sorted((i, int(j)))) for i in range(n) for j in np.lexsort((np.arange(n), d2[i]))[:k]}
    assert {(r.i, r.j) for r in graph.nearest_edges(df, k).collect()} == want
    root, tree = list(range(n)), set()

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    for _, i, j in sorted((d[i, j], i, j) for i in range(n) for j in range(i + 1, n) if d[i, j] > 0):
        a, b = top(i), top(j)
        if a != b:
            root[a] = b
            tree.add((i, j))
    assert {(r.i, r.j) for r in graph.spanning_tree(df).collect()} == tree


def test_local_fits_need_no_cross_join(spark):
    xy = PLACES["clusters and far points"]
    n = len(xy)
    pdf = pd.DataFrame({"id": np.arange(n), "px": xy[:, 0], "py": xy[:, 1], "x1": RNG.random(n), "y": RNG.random(n)})
    obs = local.observations(spark.createDataFrame(pdf), "y", ["x1"])
    fit = local.local_fit(obs, 30)
    assert "CartesianProduct" not in fit._jdf.queryExecution().toString() and "NestedLoop" not in fit._jdf.queryExecution().toString()
    every = local._finished(local.with_reach(local.pairs(obs), F.lit(30)), 2, "bisquare").orderBy("id").toPandas()
    got = fit.orderBy("id").toPandas()
    assert np.allclose(got[["b0", "b1", "hat"]], every[["b0", "b1", "hat"]], rtol=1e-7, atol=1e-9)


def test_clusters_refuse_folders_of_one_machine(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())
    assert shared_folder(spark)
