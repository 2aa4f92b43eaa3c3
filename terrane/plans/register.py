"""How the catalogue's modules list their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns to so many digits, without a negative zero."""
    return df.select(*((F.round(F.col(f"`{c}`"), digits) + 0.0).alias(c) if kind in ("double", "float") else F.col(f"`{c}`") for c, kind in df.dtypes))


class Register:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None, ctes: tuple[str, ...] = ()):
        """Lists a query under its function's name; sql is what DuckDB runs, after the common table expressions."""

        def wrap(f: Query) -> Query:
            key = name or f.__name__
            self.queries[key] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
            if sql is not None:
                self.oracles[key] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
            return f

        return wrap
