"""Interval summaries over event time: an extension, as studies are static tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import interval95


def windowed_means(events: DataFrame, value: str = "value", by: str = "event_type", time: str = "ts", length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Mean, interval and count of each window and group of a streaming or static table; rows later than `late` are left out of a stream."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.window(time, length), by).agg(*interval95(value, value))
    return out.select(F.col("window.start").alias("start"), by, *[c for c in out.columns if c not in ("window", by)])
