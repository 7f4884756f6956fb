"""Reductions of measured facts: three kinds of median, interval unions, top rows, latest rows, modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _nth(rows: DataFrame, group: str, value: str, index: Column, descending: bool) -> DataFrame:
    """The value at an index, counted from 0, of each group's ordered values; `index` may use the group's n.

    Equal values are counted before the shuffle and only distinct ones are ordered, so no group is collected.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("k"))
    order = F.desc(value) if descending else F.asc(value)
    counts = counts.withColumn("upto", F.sum("k").over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    counts = counts.withColumn("n", F.sum("k").over(Window.partitionBy(group)))
    return counts.where((F.col("upto") > index) & (F.col("upto") - F.col("k") <= index)).select(group, value)


def upper_median(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The element at floor(n / 2) of each group's ascending values; not interpolated."""
    return _nth(rows, group, value, F.floor(F.col("n") / 2), False)


def slowest_but(rows: DataFrame, group: str, value: str, per: int = 50) -> DataFrame:
    """The largest value of each group after leaving out one of every `per`: how long interactions take at worst."""
    return _nth(rows, group, value, F.least(F.col("n") - 1, F.floor(F.col("n") / per)), True)


def top_per_group(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group with their rank; Spark keeps n rows a group before the shuffle."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("int")).where(F.col("rn") <= n)


def interval_union(rows: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """(group, covered): length that a group's intervals cover together, overlaps counted once."""
    before = Window.partitionBy(group).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(before)
    fresh = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce(reach, F.col(start))))
    return rows.withColumn("fresh", fresh).groupBy(group).agg(F.sum("fresh").alias("covered"))


def latest_per_key(rows: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """The row with the largest `order` of each key, by a partial maximum of structs instead of a sort."""
    top = rows.groupBy(key).agg(F.max(F.struct(*order, *keep)).alias("m"))
    return top.select(key, *[F.col(f"m.{c}").alias(c) for c in keep])


def mode_per_group(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of each group, of equally frequent ones the least."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value))).alias("m"))
    return best.select(group, F.col(f"m.{value}").alias(value))


def first_known(rows: DataFrame, group: str, order: str, values: dict[str, str]) -> DataFrame:
    """(group, ...): the first value that is not null of each column of `values` (column -> name), as one partial aggregation."""
    return rows.groupBy(group).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(name) for c, name in values.items()])


def recent(rows: DataFrame, group: str, order: list[Column], value: str, n: int, name: str) -> DataFrame:
    """(group, name): the values of the first n rows joined by `>`; rows are cut before they are listed, so lists stay short."""
    top = top_per_group(rows, group, order, n)
    return top.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", value))), lambda s: s[value]), ">").alias(name))
