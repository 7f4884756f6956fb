"""Joins whose small side is counted before it is broadcast, and running values over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut_lineage, written

#: Rows of a few short columns that may be broadcast: about 10 MB.
SMALL_ROWS = 50_000
#: Rows of one key that are worth a way of their own.
HOT_ROWS = 10_000


def sized_join(rows: DataFrame, values: DataFrame, key: str, how: str = "inner", small: int = SMALL_ROWS) -> DataFrame:
    """`rows` joined (inner or left) with `values`, in which `key` is unique, such that no key fills a task.

    Values that are counted to be few are broadcast. Beyond that, keys that many rows have are counted (with partial
    sums), and their rows meet their values by broadcast; only the others are shuffled by key.
    """
    values = written(values)  # counted and joined, but made once
    if values.limit(small + 1).count() <= small:
        return rows.join(F.broadcast(values), key, how)
    keys = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_ROWS).select(key)
    keys = cut_lineage(keys)
    if keys.limit(small + 1).count() > small:  # so many hot keys that none is large against the whole
        return rows.join(values, key, how)
    hot = F.broadcast(keys)
    there = rows.join(hot, key, "left_semi").join(F.broadcast(values.join(hot, key, "left_semi")), key, how)
    return there.unionByName(rows.join(hot, key, "left_anti").join(values, key, how))


def running_total(rows: DataFrame, group: str, order: list[Column], value: Column, name: str = "before") -> DataFrame:
    """`rows` with the sum of `value` over the earlier rows of their group; no task holds a group.

    Rows are dealt out by ranges of (group, order) and summed within a range. A group that goes on over several
    ranges gets the totals of the ranges before: one row for each range at most, so these are broadcast.
    """
    laid = cut_lineage(rows.withColumn("_value", value).repartitionByRange(F.col(group).asc(), *order).sortWithinPartitions(F.col(group).asc(), *order))
    laid = laid.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    inside = Window.partitionBy("_part", group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    totals = laid.groupBy("_part", group).agg(F.sum("_value").alias("_total"))
    ranges = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumn("_carried", F.sum("_total").over(ranges)).where("_carried IS NOT NULL").select(F.col("_part").alias("_range"), F.col(group).alias("_group"), "_carried")
    met = laid.join(F.broadcast(carried), (F.col("_part") == F.col("_range")) & F.col(group).eqNullSafe(F.col("_group")), "left")
    total = F.coalesce(F.sum("_value").over(inside), F.lit(0)) + F.coalesce("_carried", F.lit(0))
    return met.withColumn(name, total.cast("long")).drop("_value", "_at", "_part", "_range", "_group", "_carried")
