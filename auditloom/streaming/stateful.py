"""Operators with state of their own: caps, seen-sets and tables of newest rows over rows as they arrive.

The processors run in `transformWithStateInPandas`, one call for each key and batch, with a state per key that expires:
its size follows the keys seen within the time to live, not the stream. They need the RocksDB state store (`STATE`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The setting that these operators need, before the query starts.
STATE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
CAPPED = "url string, issue string, current_value string, element string"


class _Cap(StatefulProcessor):
    """Hands on the first `cap` rows of a key; when the key's time has passed, one more that says how many were left out."""

    def __init__(self, cap: int, after_ms: int, at: str):
        self.cap, self.after_ms, self.at = cap, after_ms, at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.seen.get()[0] if self.seen.exists() else 0
        for part in rows:
            if n == 0 and len(part):  # one timer a key: from the least time of its first rows on
                self.handle.registerTimer(int(part[self.at].min().timestamp() * 1000) + self.after_ms)
            kept = part.iloc[: max(0, self.cap - n)]
            n += len(part)
            if len(kept):
                yield kept[["url", "issue", "current_value", "element"]]
        self.seen.update((n,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n = self.seen.get()[0] if self.seen.exists() else 0
        self.seen.clear()
        if n > self.cap:
            yield pd.DataFrame({"url": [key[0]], "issue": [key[1]], "current_value": [f"{n - self.cap} more occurrences not listed"], "element": [""]})

    def close(self) -> None:
        pass


def capped(stream: DataFrame, cap: int = 50, at: str = "ts", late: str = "10 minutes", after_ms: int = 3_600_000) -> DataFrame:
    """At most `cap` rows for each url and check of a stream of issues, in order of arrival, and one that says how many are left out.

    A key closes when the watermark is `after_ms` beyond the key's first rows; then its count is told and forgotten, and
    later rows of the key start anew. Rows later than `late` are left out.
    """
    keyed = stream.withWatermark(at, late).groupBy("url", "issue")
    return keyed.transformWithStateInPandas(_Cap(cap, after_ms, at), CAPPED, "Append", "EventTime")


class _Seen(StatefulProcessor):
    """Hands on the first row of a key; a key is forgotten when its time to live has passed since it was last written."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "yes boolean", self.ttl_ms) if self.ttl_ms else handle.getValueState("seen", "yes boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.seen.exists()
        for part in rows:
            if not known and len(part):
                self.seen.update((True,))
                known = True
                yield part.iloc[:1]

    def close(self) -> None:
        pass


def first_seen(stream: DataFrame, key: str, ttl_ms: int | None = None) -> DataFrame:
    """The first row of each key, as it comes; with `ttl_ms` a key counts as new again after so much processing time."""
    return stream.groupBy(key).transformWithStateInPandas(_Seen(ttl_ms), stream.schema, "Append", "ProcessingTime" if ttl_ms else "None")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions in a folder, by the session's file system."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    found = []
    for status in files.listStatus(folder):
        name = re.fullmatch(r"version=(\d+)", status.getPath().getName())
        if name and files.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(int(name[1]))
    return sorted(found)


def merged_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that `merge_latest` keeps in the folder: its newest complete version, None before the first."""
    known = _versions(spark, path)
    return spark.read.parquet(f"{path}/version={known[-1]}") if known else None


def merge_latest(keyed: str, order: str, path: str, keep: int = 2):
    """A foreachBatch function that keeps a table with the newest row of each key.

    Every batch is merged with the version before it and written as a version of its own, so a failure leaves the last
    complete version readable, and a batch that runs again starts from the same one and gives the same table. Equal
    orders are settled by the other columns. The `keep` newest versions stay, for readers that are still at work.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [v for v in _versions(spark, path) if v < batch_id]
        rows = batch.where(F.col(keyed).isNotNull())
        if before:
            rows = rows.unionByName(spark.read.parquet(f"{path}/version={before[-1]}"))
        others = [c for c in batch.columns if c not in (keyed, order)]
        newest = rows.groupBy(keyed).agg(F.max(F.struct(order, *others)).alias("_newest")).select(keyed, "_newest.*")
        newest.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/version={batch_id}")
        jvm = spark.sparkContext._jvm
        for old in before[: max(0, len(before) + 1 - keep)]:
            folder = jvm.org.apache.hadoop.fs.Path(f"{path}/version={old}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    return write


