"""Local regression, searches, clusters and refinement on 159 counties, held against published figures."""

from dataclasses import replace
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrane.config import VARIANTS, Local
from terrane.functions.columns import scaled
from terrane.operators import graph, local, metrics, partition
from terrane.operators.search import best, continuous_golden, curve, discrete_golden, scores_of, search

HERE = Path(__file__).parent / "fixtures"
TERMS = ["PctFB", "PctBlack", "PctRural"]


@pytest.fixture(scope="module")
def counties(spark):
    pdf = pd.read_csv(HERE / "georgia_counties.csv").rename(columns={"X": "px", "Y": "py"})
    labels = pd.read_csv(HERE / "georgia_initial_labels.csv")
    pdf["id"], pdf["regime"] = range(len(pdf)), pdf.merge(labels, on="AreaKey", how="left", validate="1:1")["K6"]
    df = scaled(spark.createDataFrame(pdf[["id", "AreaKey", "px", "py", "PctBach", *TERMS, "regime"]]), ["PctBach", *TERMS])
    return df.cache()


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(pd.read_csv(HERE / "georgia_edges.csv")).cache()


@pytest.fixture(scope="module")
def obs(counties):
    return local.observations(counties, "PctBach", TERMS, keep=["regime"]).cache()


def test_exhaustive_search(obs):
    k, score, trace = search(obs)
    assert (k, len(trace)) == (116, 152)
    assert score == pytest.approx(298.9855995813665, rel=1e-12)
    assert dict(trace)[8] == pytest.approx(1489.9196533274649, rel=1e-9)
    fit = local.diagnostics(local.local_fit(obs, 116), obs).first()
    assert fit.rss == pytest.approx(51.082900556856075, rel=1e-11)
    assert fit.r2 == pytest.approx(0.6787238958688298, rel=1e-11)
    assert fit.trace == pytest.approx(11.912091033737672, rel=1e-11)


def test_compatible_golden_search(obs):
    k, score, trace = search(obs, how="golden")
    assert [x for x, _ in trace] == [90, 117, 133, 106, 123, 112, 119, 115] and k == 117
    assert score == pytest.approx(299.0508086830287, rel=1e-12)
    fit = local.diagnostics(local.local_fit(obs, 117, boundary="factor"), obs).first()
    assert (fit.rss, fit.trace) == (pytest.approx(51.186191553463985, rel=1e-11), pytest.approx(11.804769716730094, rel=1e-11))


def test_distance_search_ends_where_published(obs):
    found, score, trace = search(obs, counts=False)  # over the whole published range
    assert score == pytest.approx(297.26274214557037, rel=1e-9)
    assert found == pytest.approx(288294.217, rel=1e-3)


def test_golden_sections_on_plain_functions():
    assert discrete_golden(lambda k: (k - 37) ** 2, 5, 90)[0] == 37
    assert continuous_golden(lambda b: (b - 3.25) ** 2, 1.0, 9.0)[0] == pytest.approx(3.25, abs=1e-3)
    with pytest.raises(ValueError):
        discrete_golden(lambda k: k, 9, 5)
    with pytest.raises(RuntimeError):
        continuous_golden(lambda b: float("inf"), 1.0, 2.0)


def test_curve_matches_single_fits(obs):
    got = {r.k: r for r in curve(obs, 20, 40).where("k % 10 = 0").collect()}
    for k, r in got.items():
        one = local.diagnostics(local.local_fit(obs, int(k), strict=True), obs).first()
        assert (r.rss, r.trace, r.aicc) == tuple(pytest.approx(x, rel=1e-9) for x in (one.rss, one.trace, one.aicc))


def test_criteria_are_the_published_ones(obs):
    fit = metrics.criteria(local.diagnostics(local.local_fit(obs, 117, boundary="factor"), obs)).first()
    assert (fit.aic, fit.bic) == (pytest.approx(296.61592295199813, rel=1e-11), pytest.approx(335.91253454413345, rel=1e-11))


def test_other_kernels_score_in_batches(obs, monkeypatch):
    got = {r.k: r.aicc for r in scores_of(obs, [40, 60, 90], "gaussian").collect()}
    for k, score in got.items():
        one = local.diagnostics(local.local_fit(obs, k, "gaussian", strict=True), obs).first()
        assert score == pytest.approx(one.aicc, rel=1e-9)
    k, score, trace = search(obs, "exponential", low=20, high=70)
    assert len(trace) == 51 and score == min(v for _, v in trace) and dict(trace)[k] == score


def test_graph_of_counties(spark, counties, edges):
    row = graph.graph_summary(counties, edges).first()
    assert (row.n_nodes, row.n_edges, row.degree_min, row.degree_max, row.degree_median, row.isolates) == (159, 431, 1, 11, 5, 0)
    assert row.degree_mean == pytest.approx(5.4214, abs=1e-4) and row.density == pytest.approx(0.0343126, abs=1e-7)
    assert graph.components(counties, edges).select("root").distinct().count() == 1
    assert graph.cut_edges(edges, counties).where("cut").count() == 102
    assert all(r.connected for r in graph.regimes_connected(edges, counties).collect())


def test_regime_fit(obs):
    fit = local.diagnostics(local.regime_fit(obs), obs).first()
    assert (fit.rss, fit.trace, fit.aicc) == (pytest.approx(43.1001, abs=1e-4), pytest.approx(39.7019, abs=1e-4), pytest.approx(354.0115, abs=1e-4))
    plain = local.ols(obs, ["regime"])
    assert plain.count() == 6
    shared = local.diagnostics(local.shared_fit(obs, 159), obs).first()
    assert (shared.rss, shared.trace, shared.aicc) == (pytest.approx(47.5866, abs=1e-4), pytest.approx(27.5850, abs=1e-4), pytest.approx(329.6517, abs=1e-4))


def test_ward_partitions_equal_published_ones(spark, counties, edges, obs):
    coef = local.local_fit(obs, 116).cache()
    rows = scaled(coef.select("id", "b1", "b2", "b3"), ["b1", "b2", "b3"]).withColumn("instance", F.lit("g"))
    got = partition.ward_labels(rows, edges, ["b1", "b2", "b3"], range(2, 16)).toPandas()
    want = pd.read_csv(HERE / "georgia_initial_labels.csv")
    for k in range(2, 16):
        z = got[got.k == k].sort_values("id").regime.to_numpy()
        pairs = set(zip(z, want[f"K{k}"]))
        assert len(pairs) == k, k


@pytest.mark.parametrize(("penalty", "accepted", "stop", "cuts", "rss", "trace"), [(0.05, 3, "no_label_changes", 113, 37.98060092498951, 38.1368274835972), (1.0, 8, "no_label_changes", 72, 41.20062506751219, 40.6905596659233), (0.2, 3, "objective_guard", 87, 37.50947828217361, 41.833142371488066)])
def test_refinement_of_counties(obs, edges, penalty, accepted, stop, cuts, rss, trace):
    name = f"{penalty:g}"
    labels, history, moves, path = partition.refined(obs, edges, {name: replace(VARIANTS["county"], penalty=penalty)})
    h = history.where("accepted").orderBy("iteration").toPandas()
    last = h.iloc[-1]
    assert (len(h) - 1, last.stop, last.cut_edges) == (accepted, stop, cuts)
    assert (last.rss, last.trace) == (pytest.approx(rss, rel=1e-9), pytest.approx(trace, rel=1e-9))
    want = pd.read_csv(HERE / "georgia_final_labels.csv")[f"lambda_{name}"].tolist()
    assert [r.regime for r in labels.orderBy("id").collect()] == want
    ends = partition.label_path(path, range(accepted + 1)).orderBy("id").collect()
    assert [r.final for r in ends] == want and ends[0].asDict().keys() == {"id", "start", *(f"after_{k}" for k in range(1, accepted + 1)), "final"}
    assert {r.node for r in moves.collect()} >= {r.id for r in labels.where("initial <> regime").collect()}


def test_settings_are_checked():
    for bad in ({"kernel": "flat"}, {"bandwidth": 0}, {"bandwidth": -1.0}, {"bandwidth": "all"}, {"bandwidth": 2.5, "adaptive": True}, {"search": "random"}, {"adaptive": False, "search": "exhaustive"}):
        with pytest.raises(ValueError):
            Local(**bad)
    assert Local(25).counts and not Local(25.0).counts and Local().counts


def test_small_regimes_merge_and_tree_cuts():
    x = np.array([[0.0], [0.1], [5.0], [5.1], [9.0]])
    line = np.array([[0, 1], [1, 2], [2, 3], [3, 4]])
    tree = partition.merge_tree(x, line)
    assert partition.cut_tree(5, tree, 3).tolist() == [0, 0, 1, 1, 2]
    assert partition.merge_small(np.array([0, 0, 1, 1, 2]), x, line, 2).tolist() == [0, 0, 1, 1, 1]
    assert partition.feasible_regimes(10, 5, 4) == 2 and partition.feasible_regimes(3, 5, 4) == 1


def test_every_partition_with_its_own_searches(spark, obs):
    from terrane.operators.sensitivity import searched_regimes

    labels = pd.read_csv(HERE / "georgia_initial_labels.csv")
    ids = pd.read_csv(HERE / "georgia_counties.csv")["AreaKey"]
    wide = labels.set_index("AreaKey").loc[ids].reset_index(drop=True)
    long = pd.concat([pd.DataFrame({"k": k, "id": range(len(wide)), "regime": wide[f"K{k}"]}) for k in range(2, 16)])
    got = {r.k: r for r in searched_regimes(obs.drop("regime"), spark.createDataFrame(long))[0].collect()}
    want = {2: (0.57225, 306.609), 3: (0.55129, 310.492), 4: (0.54037, 320.947), 5: (0.53018, 336.031), 6: (0.52064, 354.011)}
    for k, (rmse, score) in want.items():
        assert got[k].status == "fit" and got[k].rmse == pytest.approx(rmse, abs=1e-5) and got[k].aicc == pytest.approx(score, abs=1e-3)
    assert {got[k].status for k in (7, 8, 9)} == {"infeasible_bandwidth_search"}
    assert {got[k].status for k in range(10, 16)} == {"infeasible_small_regime"}


def test_shared_bandwidth_search(obs):
    scores = curve(obs, 8, 159, mask="regime").cache()
    row = best(scores).first()
    assert row.k == 159 and row.aicc == pytest.approx(329.6517, abs=1e-4)
    one = local.diagnostics(local.shared_fit(obs, 140), obs).first()
    at = scores.where("k = 140").first()
    assert (at.rss, at.trace) == (pytest.approx(one.rss, rel=1e-9), pytest.approx(one.trace, rel=1e-9))
    assert scores.where("k = 8").first().aicc == float("inf")


def test_multiscale_back_fitting(obs):
    from terrane.operators.multiscale import multiscale_fit

    fit = multiscale_fit(obs.withColumn("instance", F.lit("g")), ["x0", "x1", "x2", "x3"]).toPandas()
    assert list(fit.bandwidths[0]) == [92, 101, 136, 158]
    assert (fit.resid**2).sum() == pytest.approx(50.8994, abs=1e-4) and fit.trace[0] == pytest.approx(11.3683, abs=1e-4)
