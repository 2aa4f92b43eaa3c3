"""Checks of tables: counts, unique keys, complete joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assert_count(df: DataFrame, n: int, what: str = "rows") -> DataFrame:
    found = df.count()
    if found != n:
        raise ValueError(f"{found} {what}, {n} expected")
    return df


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{', '.join(keys)} isn't unique: {twice[0].asDict()}")
    return df


def assert_complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns)).first().asDict()
    if any(missing.values()):
        raise ValueError(f"missing values: {missing}")
    return df


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], many: bool = False) -> DataFrame:
    """A left join whose right keys are unique, whose left keys are too (unless many), and that finds each left row."""
    assert_unique(right, keys)
    if not many:
        assert_unique(left, keys)
    joined = left.join(right.withColumn("_found", F.lit(True)), list(keys), "left")
    return assert_complete(joined, ["_found"]).drop("_found")


def fill_missing(left: DataFrame, right: DataFrame, key: str, column: str) -> DataFrame:
    """left with column, filled from right where it is absent or null."""
    other = right.select(key, F.col(column).alias("_fill"))
    own = F.col(column) if column in left.columns else F.lit(None)
    return left.join(other, key, "left").withColumn(column, F.coalesce(own, F.col("_fill"))).drop("_fill")
