"""Queries of regimes: fits within them, clusters, refinement, recovery."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..api import discover_regimes
from ..config import VARIANTS
from ..functions.columns import dense_labels, labels_by_centroid, scaled
from ..operators import graph, local, metrics, partition
from ..operators.multiscale import multiscale_fit
from ..operators.search import best, curve
from ..operators.sensitivity import searched_regimes
from ..tables import kept
from .graphs import CUT
from .register import Register
from .tables import EDGES, PAIRS, PTS, edges, fit_sql, observed, points, reach_sql

_r = Register()
QUERIES, ORACLES, query = _r.queries, _r.oracles, _r.add
R = "round({}, 6) + 0.0".format
_FIT = f"SELECT id, {R('b0')} AS b0, {R('b1')} AS b1, {R('fitted')} AS fitted, {R('resid')} AS resid, {R('hat')} AS hat FROM f"
WITHIN = "(SELECT * FROM pairs WHERE fr = regime)"


@query(_FIT, ctes=(PTS, PAIRS, fit_sql("f", reach_sql("n", source=WITHIN))))
def regime_gwr_regime_size(spark, d):
    return local.regime_fit(observed(spark, d))


@query(_FIT, ctes=(PTS, PAIRS, fit_sql("f", reach_sql("50", source=WITHIN))))
def regime_gwr_int_k(spark, d):
    return local.regime_fit(observed(spark, d), 50)


@query(_FIT, ctes=(PTS, PAIRS, fit_sql("f", reach_sql("CASE fr WHEN 1 THEN 40 WHEN 2 THEN 60 ELSE 80 END", source=WITHIN))))
def regime_gwr_mapping(spark, d):
    return local.regime_fit(observed(spark, d), {1: 40, 2: 60, 3: 80})


_REACHED = reach_sql("150")


@query(_FIT, ctes=(PTS, PAIRS, fit_sql("f", f"SELECT * FROM ({_REACHED}) WHERE fr = regime")))
def regime_gwr_shared_k(spark, d):
    return local.shared_fit(observed(spark, d), 150)


def _running(source: str, weighs: str = "1.0") -> str:
    """CTEs of running sums over each row's sorted neighbours: k, and the moments at the bandwidth of each k."""
    sums = ", ".join(f"sum({weighs} * {t} * pow(u, {e})) OVER w AS {n}{e}" for n, t in (("a", "1.0"), ("b", "x1"), ("c", "x1 * x1"), ("p", "yy"), ("q", "x1 * yy")) for e in (0, 1, 2))
    at = ", ".join(f"{n}0 - 2 * {n}1 / u + {n}2 / (u * u) AS {n}" for n in "abcpq")
    return f"""rs AS (SELECT i, fr, fx, fy, u, rn AS k, sum({weighs}) OVER w AS held, {sums}
  FROM (SELECT *, d2 / max(d2) OVER (PARTITION BY i) AS u, row_number() OVER (PARTITION BY i ORDER BY d2, j) AS rn FROM {source})
  WINDOW w AS (PARTITION BY i ORDER BY rn ROWS UNBOUNDED PRECEDING)),
rv AS (SELECT i, fr, fx, fy, k, held, {at} FROM rs WHERE u > 0 AND k >= 8),
rf AS (SELECT *, a*c - b*b AS det, a*c - b*b > 1e-10 * (a + c) * (a + c) AND held >= 2 AS told FROM rv),
rr AS (SELECT *, CASE WHEN told THEN fy - ((c*p - b*q) + (a*q - b*p) * fx) / det END AS resid, CASE WHEN told THEN (c - 2*b*fx + a*fx*fx) / det END AS hat FROM rf)"""


_AICC = "n * ln(rss / n) + n * ln(2 * pi()) + n * (n + tr) / (n - 2 - tr)"
_SHARED = "sg AS (SELECT k, count(*)::DOUBLE AS n, count(resid) AS told, sum(resid * resid) AS rss, sum(hat) AS tr FROM rr GROUP BY k)"
_CAN = "told = n AND n - 2 - tr > 0"


@query(f"SELECT k::INT AS k, CASE WHEN {_CAN} THEN {R(_AICC)} END AS aicc, CASE WHEN {_CAN} THEN 'fit' ELSE 'unidentified' END AS status FROM sg", ctes=(PTS, PAIRS, _running("pairs", "CASE WHEN fr = regime THEN 1.0 ELSE 0.0 END"), _SHARED))
def shared_k_search(spark, d):
    """AICc of each shared number of neighbours, and whether every row could be told."""
    scores = curve(observed(spark, d), 8, 10**9, mask="regime")
    return scores.select("k", F.when(F.col("aicc") < float("inf"), F.col("aicc")).alias("aicc"), F.when(F.col("aicc") < float("inf"), "fit").otherwise("unidentified").alias("status"))


_OWN = f"""og AS (SELECT fr, k, count(*)::DOUBLE AS n, count(resid) AS told, sum(resid * resid) AS rss, avg(abs(resid)) AS mae, sum(hat) AS tr FROM rr GROUP BY fr, k),
os AS (SELECT *, {_AICC} AS aicc FROM og WHERE {_CAN}),
ob AS (SELECT *, row_number() OVER (PARTITION BY fr ORDER BY aicc, k) AS place FROM os),
ot AS (SELECT regime AS fr, var_pop(yy) * count(*) AS tss FROM pts GROUP BY regime)"""


@query(f"SELECT fr AS regime, n::BIGINT AS n, {R('rss')} AS rss, {R('mae')} AS mae, {R('tr')} AS trace, {R('sqrt(rss / n)')} AS rmse, {R('1 - rss / tss')} AS r2, {R('aicc')} AS aicc, k::BIGINT AS k, {R('aicc')} AS search_aicc FROM ob JOIN ot USING (fr) WHERE place = 1", ctes=(PTS, PAIRS, _running("(SELECT * FROM pairs WHERE fr = regime)"), _OWN))
def regime_gwr_independent(spark, d):
    """The best number of neighbours of each regime by its own search, and its fit's figures."""
    obs = observed(spark, d)
    chosen = best(curve(obs, 8, 10**9, within="regime"), by=("regime",)).collect()  # a row a regime
    fit = local.regime_fit(obs, {r.regime: int(r.k) for r in chosen})
    k = spark.createDataFrame([(r.regime, int(r.k), float(r.aicc)) for r in chosen], "regime long, k long, search_aicc double")
    return local.diagnostics(fit, obs, ["regime"]).join(k, "regime")


_LOO = """l AS (SELECT i, target, count(*) AS n, any_value(fx) AS fx, any_value(fy) AS fy, sum(w) a, sum(w*x1) b, sum(w*x1*x1) c, sum(w*yy) p, sum(w*x1*yy) q FROM (
  SELECT *, regime AS target, CASE WHEN d2 < b2 THEN pow(1 - d2 / b2, 2) ELSE 0 END AS w FROM (
    SELECT *, pow(sqrt(max(d2) OVER (PARTITION BY i, regime)), 2) AS b2 FROM pairs WHERE i <> j)) GROUP BY i, target)"""


@query(f"SELECT i AS id, target, n, {R('pow(fy - ((c*p - b*q) + (a*q - b*p) * fx) / (a*c - b*b), 2)')} AS error FROM l", ctes=(PTS, PAIRS, _LOO))
def loo_candidate_error(spark, d):
    return local.left_out_error(observed(spark, d), 5)


_FAR = """l AS (SELECT id, dense_rank() OVER (ORDER BY label) - 1 AS dense FROM pts)"""


@query("SELECT id, dense FROM l", ctes=(PTS, _FAR))
def relabel_dense(spark, d):
    return dense_labels(points(spark, d), "label", "dense").select("id", "dense")


@query("SELECT id, r AS placed FROM pts JOIN (SELECT label, row_number() OVER (ORDER BY avg(px), label) AS r FROM pts GROUP BY label) USING (label)", ctes=(PTS,))
def relabel_by_centroid(spark, d):
    return labels_by_centroid(points(spark, d), "label", out="placed").select("id", "placed")


def _slopes(spark, d):
    coef = local.local_fit(observed(spark, d, ("x1", "x2")), 60).select("id", "b1", "b2")
    return scaled(coef, ["b1", "b2"]).withColumn("instance", F.lit("lattice"))


@query()
def ward_labels(spark, d):
    return partition.ward_labels(_slopes(spark, d), edges(spark, d), ["b1", "b2"], range(2, 16))


@query()
def ward_diagnostics(spark, d):
    rows = _slopes(spark, d)
    labels = kept(partition.ward_labels(rows, edges(spark, d), ["b1", "b2"], range(1, 16)))
    return partition.partition_summary(labels.join(rows, ["instance", "id"]), edges(spark, d), ["b1", "b2"])


@query()
def ward_merge_cost(spark, d):
    return partition.merge_costs(ward_diagnostics(spark, d))


@query()
def ward_label_table(spark, d):
    """A row an id, a column a number of regimes."""
    return partition.ward_labels(_slopes(spark, d), edges(spark, d), ["b1", "b2"], range(2, 16)).withColumn("k", F.concat(F.lit("K"), F.col("k"))).groupBy("id").pivot("k", [f"K{k}" for k in range(2, 16)]).agg(F.first("regime") + 1)


# a given labeling is summarized, so that SQL can follow
_CENTRE = "c AS (SELECT regime, avg(x1) AS m1, avg(x2) AS m2 FROM pts GROUP BY regime)"


@query(f"SELECT 3::BIGINT AS k, {R('sum(pow(x1 - m1, 2) + pow(x2 - m2, 2))')} AS wcss, (SELECT count(*) FROM cut WHERE ri <> rj) AS cut_edges, (SELECT count(*) FROM cut) AS n_edges, (SELECT string_agg(n, ';' ORDER BY regime) FROM (SELECT regime, count(*) AS n FROM pts GROUP BY regime)) AS sizes FROM pts JOIN c USING (regime)", ctes=(PTS, EDGES, CUT, _CENTRE))
def partition_summary(spark, d):
    rows = points(spark, d).withColumn("k", F.lit(3).cast("long"))
    return partition.partition_summary(rows, edges(spark, d), ["x1", "x2"]).select("k", "wcss", "cut_edges", "n_edges", "sizes")


_GAP = "pow(x1 - m1, 2) + pow(x2 - m2, 2)"


@query(f"SELECT regime, count(*) AS n, {R(f'sum({_GAP})')} AS wcss, {R(f'avg(sqrt({_GAP}))')} AS mean_distance, {R(f'max(sqrt({_GAP}))')} AS max_distance, {R('avg(x1)')} AS mean_x1, {R('avg(x2)')} AS mean_x2, {R('stddev_pop(x1)')} AS std_x1, {R('stddev_pop(x2)')} AS std_x2 FROM pts JOIN c USING (regime) GROUP BY regime", ctes=(PTS, _CENTRE))
def regime_profile(spark, d):
    return partition.regime_profile(points(spark, d), ["x1", "x2"])


@query()
def merge_small_regimes(spark, d):
    rows = points(spark, d).withColumn("regime", F.floor(F.col("id") / 40)).withColumn("instance", F.lit("lattice"))
    return partition.merge_small_regimes(rows, edges(spark, d), ["x1", "x2"], 30)


def _start(spark, d):
    # a start that is off: the lines between regimes are moved by two columns or rows
    off = F.when(F.col("px") < 13, 1).when((F.col("py") + 2) % 20 >= 10, 2).otherwise(3).cast("long")
    return local.observations(points(spark, d).withColumn("regime", off), "yy", ["x1"], keep=["regime"])


#: The published penalties.
PENALTIES = (0.0, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0)
_GRID = {f"{p:g}": replace(VARIANTS["county"], penalty=p) for p in PENALTIES}


@query()
def refine_history(spark, d):
    return partition.refined(_start(spark, d), edges(spark, d), VARIANTS["monte_carlo"]).history


@query()
def refine_labels(spark, d):
    return partition.refined(_start(spark, d), edges(spark, d), VARIANTS["monte_carlo"]).labels


@query()
def move_drivers(spark, d):
    moves = partition.refined(_start(spark, d), edges(spark, d), VARIANTS["monte_carlo"]).moves
    return partition.decisive_moves(moves).drop("instance")


@query()
def label_path(spark, d):
    """Each row's regime at the start and after each sweep."""
    path = kept(partition.refined(_start(spark, d), edges(spark, d), VARIANTS["monte_carlo"]).path)
    reached = [r.iteration for r in path.select("iteration").distinct().orderBy("iteration").collect()]  # a row a sweep
    return partition.label_path(path, reached)


@query()
def discover_regimes_labels(spark, d):
    """End to end: pilot, graph, Ward, refinement with the estimator's own bandwidth, final fit."""
    found = discover_regimes(points(spark, d), "yy", ["x1", "x2"], regimes=3, bandwidth=60, edges=edges(spark, d))
    return found.coef.join(found.labels, "id").select("id", "regime", "b0", "b1", "b2", "fitted")


@query()
def lambda_sensitivity(spark, d):
    history = partition.refined(_start(spark, d), edges(spark, d), _GRID).history
    last = Window.partitionBy("instance").orderBy(F.desc("iteration"))
    return history.where("accepted").withColumn("r", F.row_number().over(last)).where("r = 1").drop("r")


@query()
def k_sensitivity(spark, d):
    """Figures of a fit within each Ward partition, each regime with its own search."""
    labels = kept(partition.ward_labels(_slopes(spark, d), edges(spark, d), ["b1", "b2"], range(2, 16)))
    return searched_regimes(observed(spark, d, keep=()), labels)[0]


@query()
def multiscale_gwr(spark, d):
    """A bandwidth for each term, by back-fitting."""
    obs = local.observations(points(spark, d), "yy", ["x1"]).withColumn("instance", F.lit("lattice"))
    return multiscale_fit(obs, ["x0", "x1"]).withColumn("bandwidths", F.array_join("bandwidths", ";"))


# -- recovery ------------------------------------------------------------------------------------

F60 = fit_sql("f", reach_sql("60"))
F120 = fit_sql("h", reach_sql("120"))


def _two(spark, d):
    obs = observed(spark, d)
    return local.local_fit(obs, 60), local.local_fit(obs, 120)


def _truth(spark, d):
    return points(spark, d).select("id", F.col("slope").alias("b1"))


@query(f"""SELECT model, 'b1' AS term, {R('sqrt(avg(e * e))')} AS rmse, {R('avg(abs(e))')} AS mae, {R('avg(e)')} AS bias, {R('sqrt(avg(CASE WHEN edge THEN e * e END))')} AS boundary_rmse, {R('sqrt(avg(CASE WHEN NOT edge THEN e * e END))')} AS interior_rmse
  FROM (SELECT model, b1 - slope AS e, id IN (SELECT unnest([i, j]) FROM cut WHERE ri <> rj) AS edge FROM (SELECT 'k60' AS model, id, b1 FROM f UNION ALL SELECT 'k120', id, b1 FROM h) JOIN pts USING (id)) GROUP BY model""", ctes=(PTS, EDGES, CUT, PAIRS, F60, F120))
def coef_recovery(spark, d):
    a, b = _two(spark, d)
    estimate = metrics.long_coefficients(a, {"b1": "b1"}, "k60").unionByName(metrics.long_coefficients(b, {"b1": "b1"}, "k120"))
    return metrics.recovery(estimate, metrics.long_coefficients(_truth(spark, d), {"b1": "b1"}), graph.boundary_nodes(edges(spark, d), points(spark, d)))


_JUMPS = "jumps AS (SELECT c.i, c.j, c.ri <> c.rj AS cut, abs(p.slope - q.slope) AS t, q.slope - p.slope AS ts, abs(a.b1 - b.b1) AS e, b.b1 - a.b1 AS es FROM cut c JOIN pts p ON p.id = c.i JOIN pts q ON q.id = c.j JOIN f a ON a.id = c.i JOIN f b ON b.id = c.j)"


@query(f"SELECT 'b1' AS term, {R('avg(t)')} AS true_jump, {R('avg(e)')} AS estimated_jump, {R('avg(e) / avg(t)')} AS ratio FROM jumps WHERE cut", ctes=(PTS, EDGES, CUT, PAIRS, F60, _JUMPS))
def jump_recovery(spark, d):
    pts = points(spark, d)
    cut = graph.cut_edges(edges(spark, d), pts).where("cut").select("i", "j")
    return metrics.jump_recovery(cut, _truth(spark, d), local.local_fit(observed(spark, d), 60), ["b1"])


@query(f"SELECT 'b1' AS term, {R('stddev_pop(ts)')} AS true_sd, {R('stddev_pop(es)')} AS estimated_sd, {R('sqrt(avg(pow(es - ts, 2)))')} AS rmse, {R('avg(abs(es - ts))')} AS mae, NULL::DOUBLE AS corr FROM jumps WHERE NOT cut", ctes=(PTS, EDGES, CUT, PAIRS, F60, _JUMPS))
def gradient_recovery(spark, d):
    pts = points(spark, d)
    inside = graph.cut_edges(edges(spark, d), pts).where("not cut").select("i", "j")
    return metrics.gradient_recovery(inside, _truth(spark, d), local.local_fit(observed(spark, d), 60), ["b1"])


_LONG = "lj AS (SELECT c.ri <> c.rj AS cut, c.i, c.j, m.term, m.model, abs(m.v - n.v) AS jump FROM cut c JOIN long m ON m.id = c.i JOIN long n ON n.id = c.j AND n.term = m.term AND n.model = m.model)"
_MODELS = "long AS (SELECT id, 'b0' AS term, 'k60' AS model, b0 AS v FROM f UNION ALL SELECT id, 'b1', 'k60', b1 FROM f UNION ALL SELECT id, 'b0', 'k120', b0 FROM h UNION ALL SELECT id, 'b1', 'k120', b1 FROM h)"


def _long(spark, d):
    a, b = _two(spark, d)
    return metrics.long_coefficients(a, {"b0": "b0", "b1": "b1"}, "k60").unionByName(metrics.long_coefficients(b, {"b0": "b0", "b1": "b1"}, "k120"))


def _edge_jumps(spark, d):
    cut, long = graph.cut_edges(edges(spark, d), points(spark, d)).select("i", "j", "cut"), _long(spark, d)
    a, b = long.withColumnRenamed("id", "i"), long.withColumnRenamed("id", "j").withColumnRenamed("beta", "other")
    return cut.join(a, "i").join(b, ["j", "term", "model"]).select("i", "j", "term", "model", "cut", F.abs(F.col("beta") - F.col("other")).alias("jump"))


@query("SELECT term, model, " + ", ".join(f"{R(f'{f}(CASE WHEN {c} THEN jump END)')} AS {n}_{s}" for s, c in (("cut", "cut"), ("interior", "NOT cut")) for n, f in (("mean", "avg"), ("median", "median"))) + f", {R('avg(CASE WHEN cut THEN jump END) / avg(CASE WHEN NOT cut THEN jump END)')} AS mean_ratio, {R('median(CASE WHEN cut THEN jump END) / median(CASE WHEN NOT cut THEN jump END)')} AS median_ratio FROM lj GROUP BY term, model", ctes=(PTS, EDGES, CUT, PAIRS, F60, F120, _MODELS, _LONG))
def edge_jump_summary(spark, d):
    return metrics.jump_summary(_edge_jumps(spark, d))


_POOLED = "pj AS (SELECT m.term, m.model, abs(m.v - n.v) AS estimated, CASE m.term WHEN 'b0' THEN 1.0::DOUBLE ELSE abs(p.slope - q.slope) END AS \"true\" FROM cut c JOIN long m ON m.id = c.i JOIN long n ON n.id = c.j AND n.term = m.term AND n.model = m.model JOIN pts p ON p.id = c.i JOIN pts q ON q.id = c.j WHERE c.ri <> c.rj)"


def _pooled(spark, d):
    truth = points(spark, d).select("id", F.col("slope").alias("b1"))
    true = metrics.jumps(graph.cut_edges(edges(spark, d), points(spark, d)).where("cut").select("i", "j"), truth, ["b1"]).select("i", "j", "jump_b1")
    return _edge_jumps(spark, d).where("cut").join(true, ["i", "j"]).select("term", "model", F.col("jump").alias("estimated"), F.when(F.col("term") == "b0", 1.0).otherwise(F.col("jump_b1")).alias("true"))


@query(f"SELECT model, {R('avg(estimated) / avg(\"true\")')} AS ratio FROM pj GROUP BY model", ctes=(PTS, EDGES, CUT, PAIRS, F60, F120, _MODELS, _POOLED))
def pooled_jump_ratio(spark, d):
    return metrics.pooled_jump_ratio(_pooled(spark, d), ["model"])


@query(f"SELECT model, {R('avg(r)')} AS ratio FROM (SELECT model, term, avg(estimated) / avg(\"true\") AS r FROM pj GROUP BY model, term) GROUP BY model", ctes=(PTS, EDGES, CUT, PAIRS, F60, F120, _MODELS, _POOLED))
def mean_jump_ratio(spark, d):
    return metrics.mean_jump_ratio(_pooled(spark, d), ["model"])


@query(f"SELECT regime, term, {R('stddev_pop(v)')} AS sd FROM (SELECT regime, unnest(['slope', 'x1', 'x2']) AS term, unnest([slope, x1, x2]) AS v FROM pts) GROUP BY regime, term", ctes=(PTS,))
def spread_within_regimes(spark, d):
    return metrics.spread_within(points(spark, d), ["slope", "x1", "x2"])


_RMSE = "rm AS (SELECT label, sqrt(avg(pow(f.resid, 2))) AS a, sqrt(avg(pow(h.resid, 2))) AS b FROM f JOIN h USING (id) JOIN pts USING (id) GROUP BY label)"


@query(f"SELECT label, {R('a')} AS a, {R('b')} AS b, {R('a - b')} AS fit_diff, {R('(b - a) / b * 100')} AS fit_pct FROM rm", ctes=(PTS, PAIRS, F60, F120, _RMSE))
def fit_improvement(spark, d):
    a, b = _two(spark, d)
    rows = points(spark, d).select("id", "label").join(a.select("id", F.col("resid").alias("ra")), "id").join(b.select("id", F.col("resid").alias("rb")), "id")
    rmse = rows.groupBy("label").agg(F.sqrt(F.avg(F.pow("ra", 2))).alias("a"), F.sqrt(F.avg(F.pow("rb", 2))).alias("b"))
    return metrics.compared(rmse, "a", "b", "fit")


@query(f"SELECT term, {R('avg(b - a)')} AS mean_diff, {R('median(b - a)')} AS median_diff, {R('avg(CASE WHEN b > a THEN 1.0 ELSE 0.0 END)')} AS share_greater, {R('avg(b) / avg(a)')} AS ratio_of_means FROM (SELECT term, i, j, max(CASE WHEN model = 'k120' THEN jump END) AS a, max(CASE WHEN model = 'k60' THEN jump END) AS b FROM lj WHERE cut GROUP BY term, i, j) GROUP BY term", ctes=(PTS, EDGES, CUT, PAIRS, F60, F120, _MODELS, _LONG))
def jump_amplification(spark, d):
    wide = _edge_jumps(spark, d).where("cut").groupBy("term", "i", "j").pivot("model", ["k120", "k60"]).agg(F.first("jump"))
    return metrics.jump_amplification(wide.withColumnRenamed("k120", "a").withColumnRenamed("k60", "b"))


@query(f"SELECT 'k120' AS model_a, 'k60' AS model_b, term, {R('avg(a - b)')} AS mean_diff, {R('avg(abs(a - b))')} AS mean_abs, {R('sqrt(avg(pow(a - b, 2)))')} AS rms, {R('max(abs(a - b))')} AS max_abs, {R('corr(a, b)')} AS corr FROM (SELECT id, term, max(CASE WHEN model = 'k120' THEN v END) AS a, max(CASE WHEN model = 'k60' THEN v END) AS b FROM long GROUP BY id, term) GROUP BY term", ctes=(PTS, PAIRS, F60, F120, _MODELS))
def pairwise_model_diff(spark, d):
    return metrics.model_differences(_long(spark, d))


@query(f"SELECT term, model, {R('min(v)')} AS min, {R('avg(v)')} AS mean, {R('stddev_pop(v)')} AS std, {R('max(v)')} AS max, {R('median(v)')} AS median FROM long GROUP BY term, model", ctes=(PTS, PAIRS, F60, F120, _MODELS))
def coefficient_summary(spark, d):
    return metrics.describe(_long(spark, d), "beta", ["term", "model"])


_SPLIT = f"SELECT flag, count(*) AS n, {R('avg(abs(f.resid))')} AS mean_abs_a, {R('avg(abs(h.resid))')} AS mean_abs_b, {R('avg(abs(f.resid) - abs(h.resid))')} AS mean_change FROM f JOIN h USING (id) JOIN flags USING (id) GROUP BY flag"


def _split(spark, d, flag):
    a, b = _two(spark, d)
    rows = a.select("id", F.abs("resid").alias("a")).join(b.select("id", F.abs("resid").alias("b")), "id").join(flag, "id")
    return rows.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("mean_abs_a"), F.avg("b").alias("mean_abs_b"), F.avg(F.col("a") - F.col("b")).alias("mean_change"))


@query(_SPLIT, ctes=(PTS, EDGES, CUT, PAIRS, F60, F120, "flags AS (SELECT id, id IN (SELECT unnest([i, j]) FROM cut WHERE ri <> rj) AS flag FROM pts)"))
def boundary_interior_residuals(spark, d):
    pts = points(spark, d)
    at = graph.boundary_nodes(edges(spark, d), pts).withColumn("on", F.lit(True))
    return _split(spark, d, pts.select("id").join(at, "id", "left").select("id", F.coalesce("on", F.lit(False)).alias("flag")))


@query(_SPLIT, ctes=(PTS, PAIRS, F60, F120, "flags AS (SELECT id, regime <> other AS flag FROM pts)"))
def changed_unchanged_residuals(spark, d):
    return _split(spark, d, points(spark, d).select("id", (F.col("regime") != F.col("other")).alias("flag")))


_BOTH_CUTS = "two AS (SELECT a.regime <> b.regime AS t, a.other <> b.other AS g FROM edges e JOIN pts a ON a.id = e.i JOIN pts b ON b.id = e.j), n AS (SELECT count(CASE WHEN t AND g THEN 1 END) AS tp, count(CASE WHEN NOT t AND g THEN 1 END) AS fp, count(CASE WHEN t AND NOT g THEN 1 END) AS fn FROM two)"


@query(f"SELECT tp, fp, fn, {R('tp / (tp + fp)')} AS precision, {R('tp / (tp + fn)')} AS recall, {R('2 * tp / (2 * tp + fp + fn)')} AS f1, {R('tp / (tp + fp + fn)')} AS jaccard FROM n", ctes=(PTS, EDGES, _BOTH_CUTS))
def boundary_scores(spark, d):
    both = graph.with_ends(edges(spark, d), points(spark, d), ["regime", "other"])
    return metrics.boundary_scores(both.select((F.col("regime_i") != F.col("regime_j")).alias("t"), (F.col("other_i") != F.col("other_j")).alias("g")), "t", "g")


@query(f"SELECT {R('(s - sa * sb / t) / ((sa + sb) / 2 - sa * sb / t)')} AS ari FROM (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT count(*) n FROM pts GROUP BY regime, other)) s, (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT count(*) n FROM pts GROUP BY regime)) sa, (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT count(*) n FROM pts GROUP BY other)) sb, (SELECT count(*) * (count(*) - 1) / 2.0 FROM pts) t)", ctes=(PTS,))
def adjusted_rand(spark, d):
    return metrics.adjusted_rand(points(spark, d), "regime", "other")


_PERMUTED = "cc AS (SELECT other AS p, regime AS t, count(*) AS n FROM pts GROUP BY ALL), w AS (SELECT a.t AS a, b.t AS b, c.t AS c, a.n + b.n + c.n AS n FROM cc a, cc b, cc c WHERE a.p = 1 AND b.p = 2 AND c.p = 3 AND a.t <> b.t AND a.t <> c.t AND b.t <> c.t ORDER BY n DESC, a, b, c LIMIT 1)"


@query("SELECT unnest([1, 2, 3])::BIGINT AS pred, unnest([a, b, c]) AS \"true\" FROM w", ctes=(PTS, _PERMUTED))
def label_alignment(spark, d):
    return partition.best_match(points(spark, d).groupBy(F.col("other").alias("pred"), F.col("regime").alias("true")).agg(F.count(F.lit(1)).alias("n")))


# -- moves between two labelings -------------------------------------------------------------------


@query("SELECT regime, " + ", ".join(f"count(CASE WHEN other = {k} THEN 1 END) AS to_{k}" for k in range(1, 7)) + " FROM (SELECT unnest([1, 2, 3, 4, 5, 6])::BIGINT AS regime) LEFT JOIN pts USING (regime) GROUP BY regime", ctes=(PTS,))
def transition_matrix(spark, d):
    return metrics.transitions(points(spark, d), "regime", "other", range(1, 7))


@query("SELECT regime || '→' || other AS move, count(*) AS n FROM pts WHERE regime <> other GROUP BY regime, other", ctes=(PTS,))
def transition_long(spark, d):
    return points(spark, d).where("regime <> other").groupBy("regime", "other").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "regime", "other").select(F.concat_ws("→", "regime", "other").alias("move"), "n")


@query("SELECT regime, coalesce(a, 0) AS initial_n, coalesce(b, 0) AS final_n, coalesce(b, 0) - coalesce(a, 0) AS delta FROM (SELECT unnest([1, 2, 3, 4, 5, 6])::BIGINT AS regime) LEFT JOIN (SELECT regime, count(*) AS a FROM pts GROUP BY regime) USING (regime) LEFT JOIN (SELECT other AS regime, count(*) AS b FROM pts GROUP BY other) USING (regime)", ctes=(PTS,))
def regime_size_change(spark, d):
    pts = points(spark, d)
    grid = spark.createDataFrame([(k,) for k in range(1, 7)], "regime long")
    a, b = pts.groupBy("regime").agg(F.count(F.lit(1)).alias("a")), pts.groupBy(F.col("other").alias("regime")).agg(F.count(F.lit(1)).alias("b"))
    return grid.join(a, "regime", "left").join(b, "regime", "left").fillna(0).select("regime", F.col("a").alias("initial_n"), F.col("b").alias("final_n"), (F.col("b") - F.col("a")).alias("delta"))


_GAPS = "gaps AS (SELECT e.i, e.j, sqrt(pow(a.b0 - b.b0, 2) + pow(a.b1 - b.b1, 2)) AS gap FROM edges e JOIN f a ON a.id = e.i JOIN f b ON b.id = e.j)"


def _gaps(spark, d):
    both = graph.with_ends(edges(spark, d), local.local_fit(observed(spark, d), 60), ["b0", "b1"])
    return both.select("i", "j", F.sqrt(F.pow(F.col("b0_i") - F.col("b0_j"), 2) + F.pow(F.col("b1_i") - F.col("b1_j"), 2)).alias("gap"))


@query(f"SELECT i, j, {R('gap')} AS gap FROM gaps", ctes=(PTS, EDGES, PAIRS, F60, _GAPS))
def fingerprint_edge_distance(spark, d):
    return _gaps(spark, d)


@query(f"SELECT id, {R('avg(gap)')} AS mean_gap, {R('max(gap)')} AS max_gap, count(*) AS degree FROM (SELECT i AS id, gap FROM gaps UNION ALL SELECT j, gap FROM gaps) GROUP BY id", ctes=(PTS, EDGES, PAIRS, F60, _GAPS))
def boundary_intensity(spark, d):
    return _gaps(spark, d).select(F.explode(F.array("i", "j")).alias("id"), "gap").groupBy("id").agg(F.avg("gap").alias("mean_gap"), F.max("gap").alias("max_gap"), F.count(F.lit(1)).alias("degree"))


@query(f"SELECT i, j, {R('gap')} AS gap FROM gaps ORDER BY gap DESC, i, j LIMIT 10", ctes=(PTS, EDGES, PAIRS, F60, _GAPS))
def edge_topk(spark, d):
    return _gaps(spark, d).orderBy(F.desc("gap"), "i", "j").limit(10)


@query(f"SELECT unnest([0, 0.25, 0.5, 0.75, 0.9, 0.95, 1])::DOUBLE AS q, {R('unnest(quantile_cont(gap, [0, 0.25, 0.5, 0.75, 0.9, 0.95, 1]))')} AS gap FROM gaps", ctes=(PTS, EDGES, PAIRS, F60, _GAPS))
def edge_quantiles(spark, d):
    at = [0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 1.0]
    values = _gaps(spark, d).agg(F.percentile("gap", F.array(*map(F.lit, at))).alias("v"))
    return values.select(F.inline(F.transform("v", lambda x, i: F.struct(F.array(*map(F.lit, at))[i].alias("q"), x.alias("gap")))))
