"""Files, checks, simulations and the query catalogue."""

import json
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrane import schema, simulate, sources
from terrane.functions.columns import interval95, key_text, scaled
from terrane.operators import graph, metrics
from terrane.plans import catalogue
from terrane.streaming import windowed_means

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Plans of many small jobs, run by the bench and the driver.
SLOW = {"multiscale_gwr", "knn_mst_graph", "bandwidth_fixed_golden", "ward_merge_cost"}


def values(df):
    rows = []
    for r in df[sorted(df.columns)].itertuples(index=False):
        rows.append(tuple(None if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else round(float(v), 5) + 0.0 if isinstance(v, (float, np.floating)) else int(v) if isinstance(v, (int, np.integer)) and not isinstance(v, bool) else str(v) for v in r))
    return sorted(rows, key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_polygons_of_a_shapefile(spark, tmp_path):
    squares = [[(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)], [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (1.0, 1.0)]]
    body = []
    for k, rings in enumerate([[squares[0]], [squares[1], squares[0]], []]):
        if rings:
            starts = np.cumsum([0, *(len(r) for r in rings)])
            content = np.array([5], "<i4").tobytes() + bytes(32) + np.array([len(rings), starts[-1], *starts[:-1]], "<i4").tobytes() + np.array([p for r in rings for p in r], "<f8").tobytes()
        else:
            content = np.array([0], "<i4").tobytes()  # a null shape
        body.append(np.array([k + 1, len(content) // 2], ">i4").tobytes() + content)
    (tmp_path / "areas.shp").write_bytes(bytes(100) + b"".join(body))
    got = sources.shapefile_vertices(spark, str(tmp_path)).orderBy("area", "ring", "seq").collect()
    assert [(r.area, r.ring, r.seq, (r.vx, r.vy)) for r in got] == [(a, k, n, p) for a, rings in ((0, [squares[0]]), (1, [squares[1], squares[0]])) for k, ring in enumerate(rings) for n, p in enumerate(ring)]
    assert got[0].file == "areas.shp"
    assert graph.contiguity_edges(sources.shapefile_vertices(spark, str(tmp_path)), "area").count() == 1


def test_long_reports_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="at most"):
        sources.write_report(spark.range(11), tmp_path / "r.md", "Long", most=10)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - SLOW))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name in catalogue.ORACLES:
        want = duck.execute(catalogue.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        # counts can come as floats where one side has nulls
        norm = lambda df: [tuple(float(x) if isinstance(x, int) else x for x in r) for r in values(df)]
        a, b = norm(got), norm(want)
        assert len(a) == len(b)
        for x, y in zip(a, b):
            assert all(p == q or (isinstance(p, float) and p == pytest.approx(q, abs=2e-5, rel=1e-9)) for p, q in zip(x, y)), (x, y)


def test_files_round_trip(spark, tmp_path):
    for scenario in ("weak", "high_noise"):
        for chunk in (0, 1):
            (tmp_path / "in" / scenario).mkdir(parents=True, exist_ok=True)
            (tmp_path / "in" / scenario / f"mc_{scenario}_chunk{chunk}.csv").write_text(f"seed,rmse\n{chunk},0.5\n")
    rows = sources.chunked_csv(spark, str(tmp_path / "in"), "seed long, rmse double")
    assert {(r.scenario, r.seed) for r in rows.collect()} == {("weak", 0), ("weak", 1), ("high_noise", 0), ("high_noise", 1)}
    for k in range(3):
        (tmp_path / f"scenario_{k}.json").write_text(json.dumps({"delta": k, "fit": {"rmse": 0.1 * k}}))
    assert sources.json_objects(spark, str(tmp_path), n=3).agg(F.sum("fit.rmse")).first()[0] == pytest.approx(0.3)
    with pytest.raises(ValueError):
        sources.json_objects(spark, str(tmp_path), n=4)
    assert sources.artifact(tmp_path / "scenario_2.json", "fit", "rmse") == 0.2 and sources.artifact(tmp_path / "none.json") is None
    sources.write_json(spark.createDataFrame([(1, float("nan"))], "a int, b double"), tmp_path / "s.json")
    assert json.loads((tmp_path / "s.json").read_text()) == {"a": 1, "b": None}
    sources.write_csv(spark.createDataFrame([(1, float("nan")), (2, 0.5)], "a int, b double"), str(tmp_path / "csv"), 1)
    assert sources.csv_table(spark, str(tmp_path / "csv"), "a int, b double").where("b IS NULL").count() == 1
    sources.write_report(spark.createDataFrame([(1, 0.25)], "a int, b double"), tmp_path / "r.md", "Figures")
    assert "| 1 | 0.25 |" in (tmp_path / "r.md").read_text()
    edges = spark.createDataFrame([(0, 1), (1, 2)], "i long, j long")
    sources.write_matrix(edges, [0, 1, 2], str(tmp_path / "w"))
    back = sources.csv_table(spark, str(tmp_path / "w"), "i long, `0` int, `1` int, `2` int").orderBy("i").collect()
    assert [tuple(r) for r in back] == [(0, 0, 1, 0), (1, 1, 0, 1), (2, 0, 1, 0)]
    assert sources.column_named(edges, "I") == "i" and sources.resolve(tmp_path / "no", tmp_path).exists()


def test_polygons_touch_at_vertices(spark):
    square = lambda a, x, y: (a, [{"x": float(x + dx), "y": float(y + dy)} for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1))])
    areas = spark.createDataFrame([square(0, 0, 0), square(1, 1, 0), square(2, 2, 1), square(3, 5, 5)], "area long, ring array<struct<x:double,y:double>>")
    edges = graph.contiguity_edges(sources.vertex_table(areas, "area", "ring"))
    assert {tuple(r) for r in edges.collect()} == {(0, 1), (1, 2)}


def test_checks(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, a string")
    b = spark.createDataFrame([(1, 0.5), (2, 0.7)], "k long, b double")
    assert schema.one_to_one(a, b, ["k"]).count() == 2
    with pytest.raises(ValueError, match="unique"):
        schema.one_to_one(a, b.union(b), ["k"])
    with pytest.raises(ValueError, match="missing"):
        schema.one_to_one(a, b.where("k = 1"), ["k"])
    assert schema.fill_missing(a, b, "k", "b").where("b > 0").count() == 2
    with pytest.raises(Exception, match="no spread"):
        scaled(b.withColumn("b", F.lit(1.0)), ["b"], small="error").collect()
    keys = spark.createDataFrame([("13001.0",), ("7",), ("x1",)], "k string").select(key_text(F.col("k"))).collect()
    assert [r[0] for r in keys] == ["13001", "7", "x1"]


def test_intervals_of_few_values(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 1.0), ("c", 3.0), ("c", float("nan"))], "g string, v double")
    got = {r.g: tuple(r)[1:] for r in rows.groupBy("g").agg(*interval95("v", "v")).collect()}
    assert got["a"] == (1.0, 1.0, 1.0, 1) and got["b"][0] is None and got["b"][3] == 0
    assert got["c"][0] == 2.0 and got["c"][3] == 2 and got["c"][2] - got["c"][1] == pytest.approx(2 * 1.96)


def test_spanning_tree_and_scores(spark):
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (1, 0), (1, 1.5), (4, 4), (4, 5.2), (9, 9.1)])], "id long, px double, py double")
    tree = graph.spanning_tree(pts).toPandas()
    assert {(a, b) for a, b in zip(tree.i, tree.j)} == {(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)}
    nothing = spark.createDataFrame([(False, False)], "t boolean, g boolean")
    assert tuple(metrics.boundary_scores(nothing, "t", "g").first())[3:] == (1.0, 1.0, 1.0, 1.0)


def test_simulations(spark):
    xy, regime, edges = simulate.lattice_arrays()
    assert len(edges) == 2352 and (regime[edges[:, 0]] != regime[edges[:, 1]]).sum() == 113
    assert graph.lattice_edges(simulate.lattice(spark).withColumn("px", F.round(F.col("px") * 24)).withColumn("py", F.round(F.col("py") * 24))).count() == 2352
    x, y, beta = simulate.piecewise()
    design = np.column_stack([np.ones(len(y)), x])
    rss = ((y - design @ np.linalg.lstsq(design, y, rcond=None)[0]) ** 2).sum()
    assert rss == pytest.approx(568.17331541746, rel=1e-6)
    strong = [simulate.replicate("strong", 2.0, 0.35, s, side=15) for s in range(2)]
    assert all(r["ari"] > 0.8 and r["slope_rmse_regime"] < r["slope_rmse_local"] for r in strong)
    null = simulate.replicate("null", 0.0, 0.75, 0, side=15)
    assert null["ari"] is None and null["f1"] is None


def test_windowed_stream(spark, tmp_path):
    rows = spark.read.parquet(f"{DATA}/events.parquet")
    want = windowed_means(rows).count()
    rows.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = windowed_means(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "events")), late="400 days")
    q = stream.writeStream.format("memory").queryName("means").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("means").count() == want
