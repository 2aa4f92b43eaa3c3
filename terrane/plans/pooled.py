"""Queries of summaries: intervals, pairs, win rates, pivots, joins that are checked, simulations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .. import simulate
from ..functions.columns import key_text
from ..operators import metrics
from ..schema import one_to_one
from .register import Register
from .tables import read

_r = Register()
QUERIES, ORACLES, query = _r.queries, _r.oracles, _r.add
R = "round({}, 6) + 0.0".format


def _interval(v: str, p: str) -> str:
    half = f"CASE WHEN count({v}) > 1 THEN 1.96 * stddev_samp({v}) / sqrt(count({v})) ELSE 0 END"
    return f"{R(f'avg({v})')} AS {p}_mean, {R(f'avg({v}) - {half}')} AS {p}_lo, {R(f'avg({v}) + {half}')} AS {p}_hi, count({v}) AS {p}_n"


@query(f"SELECT event_type, {_interval('value', 'value')} FROM events GROUP BY event_type")
def ci95_by_group(spark, d):
    return metrics.scenario_summary(read(spark, d, "events"), ["value"], "event_type")


_PAIRED = "p AS (SELECT event_type, user_id, avg(value) AS a, max(value) AS b, min(value) AS c FROM events GROUP BY event_type, user_id)"


def _paired(spark, d):
    return read(spark, d, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("a"), F.max("value").alias("b"), F.min("value").alias("c"))


_DIFF = " UNION ALL ".join(f"SELECT event_type, '{x}-{y}' AS pair, {_interval(f'({x} - {y})', 'd')} FROM p GROUP BY event_type" for x, y in (("a", "b"), ("a", "c")))


@query(f"SELECT *, d_lo > 0 OR d_hi < 0 AS excludes_zero FROM ({_DIFF})", ctes=(_PAIRED,))
def paired_diff_ci(spark, d):
    return metrics.paired_differences(_paired(spark, d), [("a", "b"), ("a", "c")], "event_type")


@query(f"SELECT event_type, count(CASE WHEN a < 50 THEN 1 END) AS wins, {R('avg(CASE WHEN a < 50 THEN 1.0 ELSE 0.0 END)')} AS win_rate, {R('avg(least(a, b, c))')} AS mean_best FROM p GROUP BY event_type", ctes=(_PAIRED,))
def win_rates(spark, d):
    rows = _paired(spark, d)
    rates = metrics.win_rates(rows, {"a": F.col("a") < 50}, ["event_type"])
    means = metrics.named_means(rows, ["event_type"], wins=F.count_if(F.col("a") < 50), mean_best=F.avg(F.least("a", "b", "c"))).drop("n")
    return rates.join(means, "event_type").select("event_type", "wins", F.col("a_rate").alias("win_rate"), "mean_best")


@query(f"SELECT event_type, {', '.join(_interval(v, v) for v in 'abc')} FROM p GROUP BY event_type", ctes=(_PAIRED,))
def scenario_wide_summary(spark, d):
    return metrics.scenario_summary(_paired(spark, d), ["a", "b", "c"], "event_type")


@query("SELECT o_orderstatus, '{' || string_agg('\"' || o_orderpriority || '\":' || n, ',' ORDER BY o_orderpriority) || '}' AS counts FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_orderstatus")
def value_counts_json(spark, d):
    return metrics.value_counts(read(spark, d, "orders"), "o_orderpriority", ["o_orderstatus"])


@query("SELECT year(l_shipdate)::BIGINT AS ship_year, " + ", ".join(f"{R(f'''avg(CASE WHEN l_returnflag = '{x}' THEN l_quantity END)''')} AS {x}" for x in "ANR") + " FROM lineitem GROUP BY 1")
def pivot_grid(spark, d):
    rows = read(spark, d, "lineitem").withColumn("ship_year", F.year("l_shipdate").cast("long"))
    return metrics.pivoted(rows, "ship_year", "l_returnflag", "ANR", F.avg("l_quantity"))


@query(f"SELECT l_returnflag, l_linestatus, {R('avg(l_quantity)')} AS mean_quantity, {R('avg(l_discount)')} AS mean_discount, max(l_tax) AS max_tax, count(*) AS n FROM lineitem GROUP BY ALL")
def group_named_means(spark, d):
    return metrics.named_means(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], mean_quantity=F.avg("l_quantity"), mean_discount=F.avg("l_discount"), max_tax=F.max("l_tax"))


@query("SELECT p_brand, min(p_partkey) AS cheapest, max_part AS dearest FROM part p JOIN (SELECT p_brand, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY p_brand) m USING (p_brand) JOIN (SELECT p_brand, min(p_partkey) AS max_part FROM part a WHERE p_retailprice = (SELECT max(p_retailprice) FROM part b WHERE b.p_brand = a.p_brand) GROUP BY p_brand) x USING (p_brand) WHERE p_retailprice = lo GROUP BY p_brand, max_part")
def best_row_argmin(spark, d):
    """Ties go to the smaller key."""
    part = read(spark, d, "part")
    cheapest, dearest = (metrics.best_rows(part, ["p_brand"], "p_retailprice", "p_partkey", largest, out) for largest, out in ((False, "cheapest"), (True, "dearest")))
    return cheapest.join(dearest, "p_brand")


@query("SELECT o_orderstatus, min(CASE WHEN total > 50 * 150000 THEN month END)::BIGINT AS first_month FROM (SELECT o_orderstatus, month(o_orderdate) AS month, sum(o_totalprice) AS total FROM orders GROUP BY ALL) GROUP BY o_orderstatus")
def first_threshold(spark, d):
    monthly = read(spark, d, "orders").groupBy("o_orderstatus", F.month("o_orderdate").alias("month")).agg(F.sum("o_totalprice").alias("total"))
    return metrics.first_over(monthly, ["o_orderstatus"], F.col("total") > 50 * 150_000, "month", "first_month").withColumn("first_month", F.col("first_month").cast("long"))


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def merge_validate_many_to_one(spark, d):
    return one_to_one(read(spark, d, "nation").withColumnRenamed("n_regionkey", "k"), read(spark, d, "region").withColumnRenamed("r_regionkey", "k"), ["k"], many=True).select("n_nationkey", "n_name", "r_name")


@query(f"SELECT s_suppkey, n_name, {R('s_acctbal - mean')} AS above FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN (SELECT c_nationkey, avg(c_acctbal) AS mean FROM customer GROUP BY c_nationkey) ON c_nationkey = s_nationkey")
def many_to_one_double_join(spark, d):
    means = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.avg("c_acctbal").alias("mean"))
    named = read(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return read(spark, d, "supplier").join(named, "s_nationkey").join(means, "s_nationkey").select("s_suppkey", "n_name", (F.col("s_acctbal") - F.col("mean")).alias("above"))


@query("SELECT 'customer' AS model, c_nationkey::BIGINT AS nation, count(*) AS n, " + R("avg(c_acctbal)") + " AS balance, NULL::DOUBLE AS parts FROM customer GROUP BY c_nationkey UNION ALL SELECT 'supplier', s_nationkey, count(*), NULL, count(DISTINCT s_suppkey)::DOUBLE FROM supplier GROUP BY s_nationkey")
def outer_union_models(spark, d):
    a = read(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("nation")).agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("balance")).withColumn("model", F.lit("customer"))
    b = read(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("nation")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s_suppkey").cast("double").alias("parts")).withColumn("model", F.lit("supplier"))
    return metrics.outer_union(a, b)


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_custkey::VARCHAR END AS key, CASE WHEN c_acctbal > 5000 AND c_nationkey > 12 THEN 'both' WHEN c_acctbal > 5000 THEN 'balance' WHEN c_nationkey > 12 THEN 'nation' ELSE 'neither' END AS class FROM customer")
def key_and_class_columns(spark, d):
    rows = read(spark, d, "customer")
    raw = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise(F.concat(F.col("c_custkey").cast("string"), F.lit(".0")))
    rich, far = F.col("c_acctbal") > 5000, F.col("c_nationkey") > 12
    return rows.select("c_custkey", key_text(raw).alias("key"), F.when(rich & far, "both").when(rich, "balance").when(far, "nation").otherwise("neither").alias("class"))


@query("SELECT id, px, py, (CASE WHEN px < 0.45 THEN 1 WHEN py >= 0.5 THEN 2 ELSE 3 END)::BIGINT AS regime FROM (SELECT range AS id, round((range % 25) / 24, 6) AS px, round(floor(range / 25) / 24, 6) AS py FROM range(625))")
def lattice(spark, d):
    return simulate.lattice(spark).select("id", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"), "regime")


_SCENARIOS = [("strong", 2.0, 0.35), ("null", 0.0, 0.75)]


@query()
def monte_carlo_replicates(spark, d):
    """Two seeds of two scenarios: recovery of each replicate. How many there are is a parameter of the study."""
    return simulate.monte_carlo(spark, _SCENARIOS, range(2)).drop("seconds")


@query()
def monte_carlo_summary(spark, d):
    """Intervals, win rates and reasons to stop of the same replicates, by scenario."""
    rows = simulate.monte_carlo(spark, _SCENARIOS, range(2))
    wins = {"regime_fit_better": F.col("fit_rmse_regime") < F.col("fit_rmse_local"), "regime_slope_better": F.col("slope_rmse_regime") < F.col("slope_rmse_local")}
    return metrics.study_summary(rows, ["ari", "f1", "slope_rmse_regime", "slope_rmse_local", "slope_rmse_oracle", "jump_regime", "jump_local"], wins)


@query()
def strength_noise_grid(spark, d):
    """A row a jump and noise of the published grid: the response's link to the terms, under the same random numbers."""
    rows = [(float(a), float(s), float((y * (beta * np.column_stack([np.ones(len(y)), x])).sum(1)).mean()), float(np.ptp(beta[:, 1]))) for a, s, (x, y, beta) in simulate.strength_noise_grid()]
    return spark.createDataFrame(rows, "delta double, sigma double, explained double, widest_slope double")


@query()
def smooth_within_recovery(spark, d):
    """How much the true slopes of the smooth design vary within each regime."""
    x, y, beta = simulate.smooth_within()
    truth = spark.createDataFrame(pd.DataFrame(beta[:, 1:], columns=["b1", "b2", "b3"]).assign(regime=simulate.lattice_arrays()[1]))
    return metrics.spread_within(truth, ["b1", "b2", "b3"])
