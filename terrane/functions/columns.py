"""Kernels, scaling and scores as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-12


def kernel_weight(d2: Column, b2: Column, kernel: str = "bisquare") -> Column:
    """The weight at a squared distance for a squared bandwidth."""
    if kernel == "bisquare":
        return F.when(d2 < b2, F.pow(1 - d2 / b2, 2)).otherwise(0.0)
    if kernel == "gaussian":
        return F.exp(-0.5 * d2 / b2)
    return F.exp(-F.sqrt(d2 / b2))


def scaled(df: DataFrame, columns: list[str], how: str = "zscore", small: str = "one", within: list[str] | None = None) -> DataFrame:
    """df with columns scaled by population moments ("zscore") or range ("minmax").

    small says what a spread of at most 1e-12 becomes: "one", "clamp" (1e-12) or
    "error" (when the rows are computed). The moments are one row, or one for
    each group of the columns in within.
    """
    part = within or []
    spread = F.stddev_pop if how == "zscore" else lambda c: F.max(c) - F.min(c)
    stats = df.groupBy(*part).agg(*[(F.avg(c) if how == "zscore" else F.min(c)).alias(f"_m{i}") for i, c in enumerate(columns)], *[spread(c).alias(f"_s{i}") for i, c in enumerate(columns)])
    joined = df.join(stats, part) if part else df.crossJoin(F.broadcast(stats))  # one row
    for i, c in enumerate(columns):
        s = F.col(f"_s{i}")
        wide = {"one": F.lit(1.0), "clamp": F.lit(TINY), "error": F.raise_error(F.lit(f"{c} has no spread")).cast("double")}[small]
        joined = joined.withColumn(c, (F.col(c) - F.col(f"_m{i}")) / F.when(s <= TINY, wide).otherwise(s))
    return joined.select(*df.columns)


def aicc(n: Column, rss: Column, trace: Column) -> Column:
    """Corrected information criterion of a Gaussian fit; infinite without degrees of freedom."""
    left = n - 2 - trace
    score = n * F.ln(F.greatest(rss, F.lit(2.2250738585072014e-308)) / n) + n * math.log(2 * math.pi) + n * (n + trace) / left
    return F.when((left > 0) & ~F.isnan(rss) & (rss < float("inf")), score).otherwise(float("inf"))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is at most 1e-12."""
    return F.when(b > TINY, a / b)


def percent_better(a: Column, b: Column) -> Column:
    """By how many per cent of b a is smaller; null where b is at most 1e-12."""
    return 100.0 * safe_ratio(b - a, b)


def key_text(key: Column) -> Column:
    """Numeric keys as whole numbers ("13001.0" is "13001"), others as they are."""
    return F.coalesce(key.cast("string").try_cast("double").try_cast("bigint").cast("string"), key.cast("string"))


def squared_norm(pairs: list[tuple[Column, Column]]) -> Column:
    total = F.lit(0.0)
    for a, b in pairs:
        total = total + (a - b) * (a - b)
    return total


def interval95(value: str, prefix: str) -> list[Column]:
    """mean, lo, hi and n aggregates: a normal 95 % interval; one value has no width, none gives null."""
    v = F.when(~F.isnan(value), F.col(value))
    half = F.when(F.count(v) > 1, 1.96 * F.stddev_samp(v) / F.sqrt(F.count(v))).otherwise(0.0)
    return [F.avg(v).alias(f"{prefix}_mean"), (F.avg(v) - half).alias(f"{prefix}_lo"), (F.avg(v) + half).alias(f"{prefix}_hi"), F.count(v).alias(f"{prefix}_n")]


def dense_labels(df: DataFrame, label: str = "regime", out: str | None = None, start: int = 0) -> DataFrame:
    """Labels as start, start + 1, ... in the order of the old ones; one row a label is ranked, not the table."""
    ranks = df.select(label).distinct().withColumn("_r", F.dense_rank().over(Window.orderBy(label)) - 1 + start)
    return df.join(ranks, label).withColumn(out or label, F.col("_r").cast("long")).drop("_r")


def labels_by_centroid(df: DataFrame, label: str = "regime", x: str = "px", out: str | None = None, start: int = 1) -> DataFrame:
    """Labels as start, start + 1, ... in the order of the regimes' mean x, then of the old labels."""
    ranks = df.groupBy(label).agg(F.avg(x).alias("_c")).withColumn("_r", F.row_number().over(Window.orderBy("_c", label)) - 1 + start)
    return df.join(ranks.drop("_c"), label).withColumn(out or label, F.col("_r").cast("long")).drop("_r")
