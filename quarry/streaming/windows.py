"""Event-time windows; every function takes a batch or a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, ts: str, delay: str | None) -> DataFrame:
    return df.withWatermark(ts, delay) if delay and df.isStreaming else df


def tumbling(df: DataFrame, ts: str, width: str, by: list[str], value: str, delay: str | None = "1 hour") -> DataFrame:
    """(start, end, keys, n, total, mean) per window; rows later than ``delay`` are dropped on a stream."""
    g = _late(df, ts, delay).groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total", "mean")


def sliding(df: DataFrame, ts: str, width: str, step: str, by: list[str], value: str, delay: str | None = "1 hour") -> DataFrame:
    g = _late(df, ts, delay).groupBy(F.window(ts, width, step), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def sessions(df: DataFrame, ts: str, gap: str, by: list[str], delay: str | None = "1 hour") -> DataFrame:
    """(start, end, keys, n): a session ends after ``gap`` without a row."""
    g = _late(df, ts, delay).groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def deduplicate(df: DataFrame, ts: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """First row of each key; on a stream within the watermark."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)
