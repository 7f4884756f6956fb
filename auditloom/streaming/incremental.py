"""Incremental runs with Structured Streaming: the same rules over pages and facts as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stateful import merge_latest


def new_urls(stream: DataFrame, url: str = "url", at: str = "ts", within: str = "1 day") -> DataFrame:
    """Urls not seen before: a seen-set whose entries expire, so that the state stays bounded."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark([url])


def windowed_metrics(stream: DataFrame, at: str, group: str, value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts, means and maxima of each group and event-time window; rows later than `late` are left out."""
    grouped = stream.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), group)
    return grouped.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("largest")).select(F.col("w.start").alias("start"), group, "n", "mean", "largest")


def upsert_latest(keyed: str, order: str, path: str):
    """A foreachBatch function that keeps the newest row of each key in a Parquet folder; `stateful.merged_table` reads it."""
    return merge_latest(keyed, order, path)
