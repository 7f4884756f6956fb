"""Reports as files: cleaned cells, nested documents, partitioned layouts, upserts of human results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rules import SITE_WIDE, rank

CELL, CONTAINER = 32_000, 2_000


def clean_cell(column: Column, kind: T.DataType) -> Column:
    """Text that any sheet or CSV reader takes: containers as JSON, no control characters, bounded length, null as empty."""
    text = F.substring(F.to_json(column), 1, CONTAINER) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else column.cast("string")
    return F.coalesce(F.substring(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), 1, CELL), F.lit(""))


def clean_cells(rows: DataFrame) -> DataFrame:
    return rows.select(*[clean_cell(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema.fields])


def documents(issues: DataFrame) -> DataFrame:
    """(report, url, critical, issues): each page's issues of a report as one nested row, gravest first.

    A page's issues are bounded by the cap on rows for each check; see scoring.cap_issues.
    """
    one = F.struct(rank(F.col("severity")).alias("rank"), "category", "issue", "severity", "current_value", "element")
    grouped = issues.groupBy("report", "url").agg(F.array_sort(F.collect_list(one)).alias("issues"), F.count_if(F.col("severity") == "Critical").alias("critical"))
    return grouped.select("report", "url", "critical", F.transform("issues", lambda i: i.dropFields("rank")).alias("issues"))


def ordered(issues: DataFrame) -> DataFrame:
    """Reading order: page urls first, other urls next, the site last; then severity, category, issue."""
    return issues.orderBy(F.col("url") == SITE_WIDE, ~F.col("url").startswith("http"), "url", rank(F.col("severity")), "category", "issue")


def write(issues: DataFrame, path: str, run_date: str, mode: str = "overwrite") -> None:
    """Parquet, JSON and CSV of a run under one folder for each date and report; a rerun replaces its own date only."""
    dated = issues.withColumn("run_date", F.lit(run_date))
    dated.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("run_date", "report").parquet(f"{path}/issues")
    documents(issues).withColumn("run_date", F.lit(run_date)).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("run_date").json(f"{path}/json")
    clean_cells(issues).withColumn("run_date", F.lit(run_date)).write.mode(mode).option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy("run_date").csv(f"{path}/csv")


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """`new` rows in place of old ones with the same key; a new row with a null status clears its key."""
    return old.join(new, key, "left_anti").unionByName(new.where("status IS NOT NULL"), allowMissingColumns=True)
