"""Recovery, comparison and summary tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import interval95, percent_better, safe_ratio
from .graph import with_ends


def long_coefficients(coef: DataFrame, terms: dict[str, str], model: str | None = None, key: str = "id") -> DataFrame:
    """(key, term, beta) of wide coefficients; terms names columns."""
    out = coef.select(key, F.explode(F.create_map(*(x for c, t in terms.items() for x in (F.lit(t), F.col(c).cast("double"))))).alias("term", "beta"))
    return out if model is None else out.withColumn("model", F.lit(model))


def boundary_scores(edges: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 and jaccard of boolean columns of edges. Nothing to find and nothing found is perfect."""
    t, g = F.col(truth), F.col(guess)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    out = edges.agg(count(t & g).alias("tp"), count(~t & g).alias("fp"), count(t & ~g).alias("fn"))
    ratio = lambda a, b: F.when(b == 0, F.lit(1.0)).otherwise(a / b)
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / F.when(both != 0, both))).withColumn("jaccard", ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the adjusted Rand index of two label columns, from their contingency counts."""
    two = lambda c: c * (c - 1) / 2
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    side = lambda c, name: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias(name))
    rows = cells.agg(F.sum(two(F.col("n"))).alias("s"), F.sum("n").alias("n")).crossJoin(side(a, "sa")).crossJoin(side(b, "sb"))  # one row each
    expected = F.col("sa") * F.col("sb") / two(F.col("n"))
    top = (F.col("sa") + F.col("sb")) / 2
    return rows.select(F.when(top == expected, 1.0).otherwise((F.col("s") - expected) / F.when(top != expected, top - expected)).alias("ari"))


def recovery(estimate: DataFrame, truth: DataFrame, boundary: DataFrame) -> DataFrame:
    """rmse, mae and bias of each model's terms (id, model, term, beta) against the truth (id, term, beta), and rmse at and off the boundary (id)."""
    rows = estimate.join(truth.select("id", "term", F.col("beta").alias("true")), ["id", "term"]).join(boundary.select("id", F.lit(True).alias("edge")), "id", "left")
    e = F.col("beta") - F.col("true")
    at = F.coalesce("edge", F.lit(False))
    return rows.groupBy("model", "term").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.sqrt(F.avg(F.when(at, e * e))).alias("boundary_rmse"), F.sqrt(F.avg(F.when(~at, e * e))).alias("interior_rmse"))


def jumps(edges: DataFrame, coef: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Edges with jump_c, the absolute difference of each column between their ends."""
    out = with_ends(edges, coef, columns)
    for c in columns:
        out = out.withColumn(f"jump_{c}", F.abs(F.col(f"{c}_i") - F.col(f"{c}_j")))
    return out


def jump_recovery(edges: DataFrame, truth: DataFrame, estimate: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(term, true_jump, estimated_jump, ratio) over the given (truly cut) edges."""
    t, e = jumps(edges, truth, columns), jumps(edges, estimate, columns)
    both = t.select("i", "j", *(F.col(f"jump_{c}").alias(f"t_{c}") for c in columns)).join(e.select("i", "j", *(F.col(f"jump_{c}").alias(f"e_{c}") for c in columns)), ["i", "j"])
    flat = both.select(F.inline(F.array(*(F.struct(F.lit(c).alias("term"), F.col(f"t_{c}").alias("t"), F.col(f"e_{c}").alias("e")) for c in columns))))
    out = flat.groupBy("term").agg(F.avg("t").alias("true_jump"), F.avg("e").alias("estimated_jump"))
    return out.withColumn("ratio", safe_ratio(F.col("estimated_jump"), F.col("true_jump")))


def pooled_jump_ratio(jumps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ratio: the mean estimated jump over the mean true jump of all slopes together. jumps: true and estimated, a row an edge and slope."""
    return jumps.groupBy(*by).agg(safe_ratio(F.avg("estimated"), F.avg("true")).alias("ratio"))


def mean_jump_ratio(jumps: DataFrame, by: Sequence[str] = (), term: str = "term") -> DataFrame:
    """ratio: the mean over slopes of each one's ratio of mean jumps; slopes without a true jump are left out."""
    each = jumps.groupBy(*by, term).agg(safe_ratio(F.avg("estimated"), F.avg("true")).alias("r"))
    return each.groupBy(*by).agg(F.avg("r").alias("ratio"))


def spread_within(coef: DataFrame, columns: Sequence[str], regime: str = "regime") -> DataFrame:
    """(regime, term, sd): how much each column varies within each regime; a truth that is constant there has zero."""
    flat = coef.select(regime, F.inline(F.array(*(F.struct(F.lit(c).alias("term"), F.col(c).cast("double").alias("v")) for c in columns))))
    return flat.groupBy(regime, "term").agg(F.stddev_pop("v").alias("sd"))


def criteria(fit: DataFrame) -> DataFrame:
    """diagnostics() with enp (effective parameters: the trace), aic, bic and adj_r2."""
    n, rss, tr = F.col("n").cast("double"), F.col("rss"), F.col("trace")
    deviance = n * F.ln(rss / n) + n * (1 + F.ln(F.lit(2.0) * F.pi()))
    left = n - tr - 1
    return fit.select("*", tr.alias("enp"), (deviance + 2 * (tr + 1)).alias("aic"), (deviance + (tr + 1) * F.ln(n)).alias("bic"), F.when(left > 0, 1 - (1 - F.col("r2")) * (n - 1) / left).alias("adj_r2"))


def compared(rows: DataFrame, a: str, b: str, prefix: str) -> DataFrame:
    """rows with prefix_diff, a - b, and prefix_pct, by how many per cent of b a is smaller."""
    return rows.withColumn(f"{prefix}_diff", F.col(a) - F.col(b)).withColumn(f"{prefix}_pct", percent_better(F.col(a), F.col(b)))


def gradient_recovery(edges: DataFrame, truth: DataFrame, estimate: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Signed differences along the given (uncut) edges: spread of both, rmse, mae and correlation by term."""
    t, e = with_ends(edges, truth, columns), with_ends(edges, estimate, columns)
    gap = lambda c: (F.col(f"{c}_j") - F.col(f"{c}_i"))
    both = t.select("i", "j", *(gap(c).alias(f"t_{c}") for c in columns)).join(e.select("i", "j", *(gap(c).alias(f"e_{c}") for c in columns)), ["i", "j"])
    flat = both.select(F.inline(F.array(*(F.struct(F.lit(c).alias("term"), F.col(f"t_{c}").alias("t"), F.col(f"e_{c}").alias("e")) for c in columns))))
    d = F.col("e") - F.col("t")
    out = flat.groupBy("term").agg(F.stddev_pop("t").alias("true_sd"), F.stddev_pop("e").alias("estimated_sd"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.covar_pop("t", "e").alias("c"))
    return out.withColumn("corr", F.when((F.col("true_sd") > 1e-12) & (F.col("estimated_sd") > 1e-12), F.try_divide("c", F.col("true_sd") * F.col("estimated_sd")))).drop("c")


def guarded_corr(a: str, b: str, tiny: float = 1e-15) -> Column:
    return F.when((F.stddev_pop(a) > tiny) & (F.stddev_pop(b) > tiny), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def model_differences(long: DataFrame) -> DataFrame:
    """Mean signed and absolute, root mean square and largest difference and correlation of each pair of models by term (id, model, term, beta)."""
    a = long.select("id", "term", F.col("model").alias("model_a"), F.col("beta").alias("a"))
    b = long.select("id", "term", F.col("model").alias("model_b"), F.col("beta").alias("b"))
    d = F.col("a") - F.col("b")
    return a.join(b, ["id", "term"]).where("model_a < model_b").groupBy("model_a", "model_b", "term").agg(F.avg(d).alias("mean_diff"), F.avg(F.abs(d)).alias("mean_abs"), F.sqrt(F.avg(d * d)).alias("rms"), F.max(F.abs(d)).alias("max_abs"), guarded_corr("a", "b").alias("corr"))


def jump_summary(edges: DataFrame, by: Sequence[str] = ("term", "model")) -> DataFrame:
    """Mean and median jump at cut and other edges, and their ratio (term, model, cut, jump)."""
    out = edges.groupBy(*by).agg(*(f(F.when(F.col("cut") == flag, F.col("jump"))).alias(f"{name}_{side}") for side, flag in (("cut", True), ("interior", False)) for name, f in (("mean", F.avg), ("median", F.median))))
    return out.withColumn("mean_ratio", safe_ratio(F.col("mean_cut"), F.col("mean_interior"))).withColumn("median_ratio", safe_ratio(F.col("median_cut"), F.col("median_interior")))


def jump_amplification(pairs: DataFrame, by: Sequence[str] = ("term",)) -> DataFrame:
    """Of jumps a and b of the same edges: mean and median of b - a, share of b > a, ratio of means."""
    d = F.col("b") - F.col("a")
    return pairs.groupBy(*by).agg(F.avg(d).alias("mean_diff"), F.median(d).alias("median_diff"), F.avg(F.when(d > 0, 1.0).otherwise(0.0)).alias("share_greater"), safe_ratio(F.avg("b"), F.avg("a")).alias("ratio_of_means"))


def describe(long: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    return long.groupBy(*by).agg(F.min(value).alias("min"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.max(value).alias("max"), F.median(value).alias("median"))


def scenario_summary(rows: DataFrame, metrics: Sequence[str], by: str = "scenario") -> DataFrame:
    """mean, lo, hi and n of each metric, by scenario, one row each."""
    return rows.groupBy(by).agg(*(c for m in metrics for c in interval95(m, m)))


def win_rates(rows: DataFrame, wins: dict[str, Column], by: Sequence[str]) -> DataFrame:
    """For each named condition: name_rate, the share of rows of a group for which it holds, and name_n, the rows it can be told for."""
    columns = [c for name, won in wins.items() for c in (F.avg(won.cast("double")).alias(f"{name}_rate"), F.count(won).alias(f"{name}_n"))]
    return rows.groupBy(*by).agg(*columns)


def value_counts(rows: DataFrame, column: str, by: Sequence[str], out: str = "counts") -> DataFrame:
    """The number of rows of each value of a column, nulls aside, as a JSON object in the order of the values."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(column).cast("string"), "n"))))  # an entry a value
    return counts.groupBy(*by).agg(F.to_json(entries).alias(out))


def named_means(rows: DataFrame, by: Sequence[str], **named: Column) -> DataFrame:
    """Groups with named aggregates, and n."""
    return rows.groupBy(*by).agg(*(c.alias(name) for name, c in named.items()), F.count(F.lit(1)).alias("n"))


def pivoted(rows: DataFrame, row: str, column: str, values: Sequence, value: Column) -> DataFrame:
    """A grid: a row a value of row, a column a value of column, the latest row first."""
    return rows.groupBy(row).pivot(column, list(values)).agg(value).orderBy(F.desc(row))


def best_rows(rows: DataFrame, by: Sequence[str], score: str, key: str, largest: bool = False, out: str = "best") -> DataFrame:
    """The key of each group's smallest (or largest) score; ties go to the smaller key."""
    order = F.struct(-F.col(score) if largest else F.col(score), F.col(key))
    return rows.groupBy(*by).agg(F.min_by(key, order).alias(out))


def first_over(rows: DataFrame, by: Sequence[str], score: Column, key: str, out: str = "first") -> DataFrame:
    """The smallest key of each group at which the condition holds, or null."""
    return rows.groupBy(*by).agg(F.min(F.when(score, F.col(key))).alias(out))


def study_summary(rows: DataFrame, metrics: Sequence[str], wins: dict[str, Column], stop: str = "stop", by: str = "scenario") -> DataFrame:
    """scenario_summary() with win rates and a JSON object of how often each reason to stop occurred."""
    out = scenario_summary(rows, metrics, by).join(win_rates(rows, wins, [by]), by)
    return out.join(value_counts(rows, stop, [by], "stop_counts"), by, "left")


def paired_differences(rows: DataFrame, pairs: Sequence[tuple[str, str]], by: str = "scenario") -> DataFrame:
    """(by, pair, mean, lo, hi, n, excludes_zero) of paired differences a - b."""
    flat = rows.select(by, F.inline(F.array(*(F.struct(F.lit(f"{a}-{b}").alias("pair"), (F.col(a) - F.col(b)).alias("d")) for a, b in pairs))))
    out = flat.groupBy(by, "pair").agg(*interval95("d", "d"))
    return out.withColumn("excludes_zero", (F.col("d_lo") > 0) | (F.col("d_hi") < 0))


def transitions(df: DataFrame, before: str, after: str, labels: Sequence) -> DataFrame:
    """The full matrix of moves between labels, zeros included: a row a label before, a column (to_x) a label after."""
    grid = df.sparkSession.createDataFrame([(x,) for x in labels], [before])
    counts = df.groupBy(before).pivot(after, list(labels)).agg(F.count(F.lit(1)))
    out = grid.join(counts, before, "left").fillna(0)
    return out.select(before, *(F.col(f"`{x}`").cast("long").alias(f"to_{x}") for x in labels))


def outer_union(*tables: DataFrame) -> DataFrame:
    """All rows of all tables; columns that one lacks are null."""
    out, *rest = tables
    for t in rest:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
