"""Every query of the driver contract by name, with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graphs, pooled, regressions, regimes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for part in (regressions, graphs, regimes, pooled):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES


