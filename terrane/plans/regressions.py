"""Queries of scaling, distances, kernels, local regression and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import kernel_weight, scaled
from ..operators import local, tiles
from ..operators.metrics import criteria
from ..operators.search import best, curve, search
from .register import Register
from .tables import FIXED, PAIRS, PTS, RADIUS, fit_sql, observed, points, reach_sql, read

_r = Register()
QUERIES, ORACLES, query = _r.queries, _r.oracles, _r.add
R = "round({}, 6) + 0.0".format


@query(f"SELECT id, {R('(x1 - avg(x1) OVER ()) / stddev_pop(x1) OVER ()')} AS x1, {R('(yy - avg(yy) OVER ()) / stddev_pop(yy) OVER ()')} AS yy FROM pts", ctes=(PTS,))
def zscore_columns(spark, d):
    return scaled(points(spark, d).select("id", "x1", "yy"), ["x1", "yy"])


@query(f"SELECT id, {R('(px - min(px) OVER ()) / (max(px) OVER () - min(px) OVER ())')} AS px, {R('(py - min(py) OVER ()) / (max(py) OVER () - min(py) OVER ())')} AS py FROM pts", ctes=(PTS,))
def minmax_coords(spark, d):
    return scaled(points(spark, d).select("id", "px", "py"), ["px", "py"], "minmax")


@query(f"SELECT c_custkey, {R('(c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER ()')} AS c_acctbal, 0.0::DOUBLE AS flat FROM customer")
def safe_standardize(spark, d):
    return scaled(read(spark, d, "customer").select("c_custkey", "c_acctbal", F.lit(7.0).alias("flat")), ["c_acctbal", "flat"])


@query(f"SELECT p_partkey, {R('(p_retailprice - min(p_retailprice) OVER (PARTITION BY p_brand)) / greatest(max(p_retailprice) OVER (PARTITION BY p_brand) - min(p_retailprice) OVER (PARTITION BY p_brand), 1e-12)')} AS p_retailprice, p_brand FROM part")
def clamped_minmax_by_group(spark, d):
    return scaled(read(spark, d, "part").select("p_partkey", "p_retailprice", "p_brand"), ["p_retailprice"], "minmax", "clamp", ["p_brand"])


@query(f"SELECT i, count(*) AS n, {R('min(CASE WHEN d2 > 0 THEN sqrt(d2) END)')} AS d_min, {R('max(sqrt(d2))')} AS d_max, {R('avg(sqrt(d2))')} AS d_mean FROM pairs GROUP BY i", ctes=(PTS, PAIRS))
def pair_distance(spark, d):
    return tiles.distances_of(observed(spark, d))


@query(f"SELECT i, {R('max(sqrt(b2))')} AS b FROM ({reach_sql('30')}) GROUP BY i", ctes=(PTS, PAIRS))
def kth_distance(spark, d):
    return local.with_reach(local.pairs(observed(spark, d), nearest=30), F.lit(30)).groupBy("i").agg(F.max(F.sqrt("b2")).alias("b"))


def _kernel(name: str, weight: str) -> None:
    @query(f"SELECT i, {R(f'sum({weight})')} AS w FROM pairs GROUP BY i", f"kernel_{name}", (PTS, PAIRS))
    def kernel(spark, d):
        if name != "bisquare":
            return tiles.weight_sums(observed(spark, d), RADIUS, name)
        table = local.pairs(observed(spark, d), radius=RADIUS)
        return table.groupBy("i").agg(F.sum(kernel_weight(F.col("d2"), F.lit(RADIUS**2), name)).alias("w"))


_kernel("bisquare", f"CASE WHEN d2 < {RADIUS**2} THEN pow(1 - d2 / {RADIUS**2}, 2) ELSE 0 END")
_kernel("gaussian", f"exp(-0.5 * d2 / {RADIUS**2})")
_kernel("exponential", f"exp(-sqrt(d2 / {RADIUS**2}))")

_FIT = f"SELECT id, {R('b0')} AS b0, {R('b1')} AS b1, {R('fitted')} AS fitted, {R('resid')} AS resid, {R('hat')} AS hat FROM f"


@query(_FIT, ctes=(PTS, PAIRS, fit_sql("f", reach_sql("60"))))
def gwr_fixed_k(spark, d):
    return local.local_fit(observed(spark, d), 60)


@query(_FIT, ctes=(PTS, PAIRS, fit_sql("f", FIXED)))
def gwr_fixed_distance(spark, d):
    return local.local_fit(observed(spark, d), RADIUS)


@query(_FIT, ctes=(PTS, PAIRS, fit_sql("f", reach_sql("60", factor=1.0000001))))
def gwr_compat_boundary(spark, d):
    return local.local_fit(observed(spark, d), 60, boundary="factor")


@query(_FIT, ctes=(PTS, PAIRS, fit_sql("f", f"SELECT *, exp(-0.5 * d2 / {RADIUS**2}) AS w FROM pairs")))
def gwr_gaussian(spark, d):
    return local.local_fit(observed(spark, d), RADIUS, "gaussian")


_QUARTER = "(SELECT count(*) // 4 FROM pts)"


@query(_FIT, ctes=(PTS, PAIRS, fit_sql("f", reach_sql(_QUARTER))))
def gwr_quarter(spark, d):
    obs = observed(spark, d)
    return local.local_fit(obs, obs.count() // 4, far=True)


@query(_FIT, ctes=(PTS, PAIRS, fit_sql("f", FIXED)))
def gwr_cells_distance(spark, d):
    return local.local_fit(observed(spark, d), RADIUS, far=True)


_THREE = f"""m AS (SELECT i, any_value(f1) AS f1, any_value(f2) AS f2, sum(w) a, sum(w*x1) b, sum(w*x2) c, sum(w*x1*x1) d, sum(w*x1*x2) e, sum(w*x2*x2) f, sum(w*yy) p, sum(w*x1*yy) q, sum(w*x2*yy) r
  FROM (SELECT *, CASE WHEN d2 < b2 THEN pow(1 - d2 / b2, 2) ELSE 0 END AS w FROM (
    SELECT *, max(CASE WHEN rn = 80 THEN d2 END) OVER (PARTITION BY i) AS b2 FROM (
      SELECT a.id AS i, a.x1 AS f1, a.x2 AS f2, b.x1, b.x2, b.yy, (a.px-b.px)*(a.px-b.px) + (a.py-b.py)*(a.py-b.py) AS d2,
        row_number() OVER (PARTITION BY a.id ORDER BY (a.px-b.px)*(a.px-b.px) + (a.py-b.py)*(a.py-b.py), b.id) AS rn FROM pts a, pts b))) GROUP BY i),
k AS (SELECT *, a*(d*f-e*e) - b*(b*f-c*e) + c*(b*e-c*d) AS det FROM m)"""


@query(f"SELECT i AS id, {R('(p*(d*f-e*e) - b*(q*f-r*e) + c*(q*e-r*d)) / det')} AS b0, {R('(a*(q*f-r*e) - p*(b*f-c*e) + c*(b*r-c*q)) / det')} AS b1, {R('(a*(d*r-e*q) - b*(b*r-c*q) + p*(b*e-c*d)) / det')} AS b2 FROM k", ctes=(PTS, _THREE))
def gwr_three_terms(spark, d):
    return local.local_fit(observed(spark, d, ("x1", "x2")), 80).select("id", "b0", "b1", "b2")


_LEVER = f"SELECT w.i, w.j, w.w * (f_b.c - f_b.b * (f_b.fx + w.x1) + f_b.a * f_b.fx * w.x1) / (f_b.a * f_b.c - f_b.b * f_b.b) AS s FROM ({reach_sql('60')}) w JOIN f_b ON w.i = f_b.i WHERE w.w > 0"


@query(f"SELECT i, count(*) AS n, {R('sum(s)')} AS total, {R('sum(s * s)')} AS squares FROM ({_LEVER}) GROUP BY i", ctes=(PTS, PAIRS, fit_sql("f", reach_sql("60"))))
def gwr_hat_row(spark, d):
    return local.hat_rows(observed(spark, d), 60).groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("total"), F.sum(F.col("s") * F.col("s")).alias("squares"))


_AICC = "n * ln(rss / n) + n * ln(2 * pi()) + n * (n + tr) / (n - 2 - tr)"
_DIAG = f"SELECT n::BIGINT AS n, {R('rss')} AS rss, {R('mae')} AS mae, {R('tr')} AS trace, {R('sqrt(rss / n)')} AS rmse, {R('1 - rss / tss')} AS r2, {R(_AICC)} AS aicc FROM (SELECT count(*)::DOUBLE AS n, sum(resid * resid) AS rss, avg(abs(resid)) AS mae, sum(hat) AS tr, var_pop(yy) * count(*) AS tss FROM f JOIN pts USING (id))"


@query(_DIAG, ctes=(PTS, PAIRS, fit_sql("f", reach_sql("60"))))
def gwr_diagnostics(spark, d):
    obs = observed(spark, d)
    return local.diagnostics(local.local_fit(obs, 60), obs)


_DEVIANCE = "n * ln(rss / n) + n * (1 + ln(2 * pi()))"


@query(f"SELECT n::BIGINT AS n, {R('tr')} AS enp, {R(f'{_DEVIANCE} + 2 * (tr + 1)')} AS aic, {R(_AICC)} AS aicc, {R(f'{_DEVIANCE} + (tr + 1) * ln(n)')} AS bic, {R('1 - rss / tss')} AS r2, {R('1 - rss / tss * (n - 1) / (n - tr - 1)')} AS adj_r2 {_DIAG[_DIAG.index('FROM'):]}", ctes=(PTS, PAIRS, fit_sql("f", reach_sql("60"))))
def gwr_criteria(spark, d):
    obs = observed(spark, d)
    return criteria(local.diagnostics(local.local_fit(obs, 60), obs)).select("n", "enp", "aic", "aicc", "bic", "r2", "adj_r2")


_SCAN = """s AS (SELECT i, fx, fy, u, rn AS k, """ + ", ".join(f"sum({t} * pow(u, {e})) OVER w AS {n}{e}" for n, t in (("a", "1.0"), ("b", "x1"), ("c", "x1 * x1"), ("p", "yy"), ("q", "x1 * yy")) for e in (0, 1, 2)) + """
  FROM (SELECT *, d2 / max(d2) OVER (PARTITION BY i) AS u, row_number() OVER (PARTITION BY i ORDER BY d2, j) AS rn FROM pairs)
  WINDOW w AS (PARTITION BY i ORDER BY rn ROWS UNBOUNDED PRECEDING)),
v AS (SELECT i, k, fx, fy, """ + ", ".join(f"{n}0 - 2 * {n}1 / u + {n}2 / (u * u) AS {n}" for n in "abcpq") + """ FROM s WHERE u > 0 AND k >= (SELECT greatest(3, ceil(0.05 * count(*))) FROM pts)),
g AS (SELECT k, count(*)::DOUBLE AS n, sum(pow(fy - ((c*p - b*q) + (a*q - b*p) * fx) / (a*c - b*b), 2)) AS rss, sum((c - 2*b*fx + a*fx*fx) / (a*c - b*b)) AS tr FROM v GROUP BY k)"""


@query(f"SELECT k::BIGINT AS k, {R('rss')} AS rss, {R('tr')} AS trace, {R(_AICC)} AS aicc FROM g WHERE k BETWEEN 20 AND 160", ctes=(PTS, PAIRS, _SCAN.replace("(SELECT greatest(3, ceil(0.05 * count(*))) FROM pts)", "20")))
def bandwidth_curve(spark, d):
    return curve(observed(spark, d), 20, 160).withColumn("k", F.col("k").cast("long"))


@query(f"SELECT k::BIGINT AS k, {R('aicc')} AS aicc FROM (SELECT k, {_AICC} AS aicc FROM g) ORDER BY aicc, k LIMIT 1", ctes=(PTS, PAIRS, _SCAN))
def bandwidth_best(spark, d):
    return best(curve(observed(spark, d))).select(F.col("k").cast("long").alias("k"), "aicc")


@query()
def bandwidth_compat_trace(spark, d):
    k, score, trace = search(observed(spark, d), how="golden")
    return spark.createDataFrame([(n, int(a), float(b), a == k) for n, (a, b) in enumerate(trace)], "step long, k long, aicc double, chosen boolean")


@query()
def bandwidth_fixed_golden(spark, d):
    found, _, trace = search(observed(spark, d), counts=False)
    return spark.createDataFrame([(float(a), float(b), a == found) for a, b in trace], "bandwidth double, aicc double, chosen boolean")


@query(f"SELECT n, {R('b0')} AS b0, {R('b1')} AS b1 FROM (SELECT count(*) AS n, regr_intercept(yy, x1) AS b0, regr_slope(yy, x1) AS b1 FROM pts)", ctes=(PTS,))
def global_ols(spark, d):
    return local.ols(observed(spark, d))


@query(f"SELECT regime, count(*) AS n, {R('regr_intercept(yy, x1)')} AS b0, {R('regr_slope(yy, x1)')} AS b1 FROM pts GROUP BY regime", ctes=(PTS,))
def regime_ols(spark, d):
    return local.ols(observed(spark, d), ["regime"])


@query("SELECT l_returnflag, count(*) AS n, round(regr_intercept(l_extendedprice, l_quantity), 3) + 0.0 AS b0, round(regr_slope(l_extendedprice, l_quantity), 3) + 0.0 AS b1 FROM lineitem GROUP BY l_returnflag")
def lineitem_ols(spark, d):
    rows = read(spark, d, "lineitem").select(F.lit(0).alias("id"), F.lit(0.0).alias("px"), F.lit(0.0).alias("py"), F.col("l_extendedprice").alias("yy"), "l_quantity", "l_returnflag")
    out = local.ols(local.observations(rows, "yy", ["l_quantity"], keep=["l_returnflag"]), ["l_returnflag"])
    return out.select("l_returnflag", "n", F.round("b0", 3).alias("b0"), F.round("b1", 3).alias("b1"))
