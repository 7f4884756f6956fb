"""Runs of reports kept as tables: a run replaces the report's earlier one, and one that breaks off leaves that readable.

Rows of a run lie in a folder of their own, `rows/report=…/attempt=…`. When they are complete, one row for each report
is appended to the `runs` table, so a run exists for readers from one moment to the next. A rerun of a run id is another
attempt and replaces the first. Old attempts go only when they are pruned, hence a reader in the middle of a run
keeps its files. One writer at a time is assumed for each report.

Defined cases: a report without any issue is named in `reports` and has a run of no rows. Attempts that never completed
are invisible and are pruned with the old ones. Reading where nothing was saved
gives empty tables. Runs with different columns are read with those of the newest one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUNS = "report string, seq long, attempt string, run_date string, run_id string, n_rows long, columns string, saved_at timestamp"


def _files(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Every completed run: report, seq (1 for the report's first), attempt, date, id, rows and time."""
    files, folder = _files(spark, f"{path}/runs")
    return spark.read.schema(RUNS).parquet(f"{path}/runs") if files.exists(folder) else spark.createDataFrame([], RUNS)


def current(spark: SparkSession, path: str, keep: int = 1) -> DataFrame:
    """The last `keep` run ids of each report, each by its last attempt; one row for each report and run id."""
    rest = [c for c in runs(spark, path).columns if c not in ("report", "run_id")]
    last = runs(spark, path).groupBy("report", "run_id").agg(F.max(F.struct("seq", *[c for c in rest if c != "seq"])).alias("r"))
    newest = last.groupBy("report").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("r.seq", "run_id", "r")))), 1, keep).alias("kept"))
    return newest.select("report", F.inline("kept")).select("report", "run_id", "r.*")


def _rows(spark: SparkSession, path: str, columns: T.StructType) -> DataFrame:
    """All attempts' rows; folder names stay texts ("02" is no number)."""
    own = [f for f in columns.fields if f.name not in ("report", "attempt")]
    schema = T.StructType([*own, T.StructField("report", T.StringType()), T.StructField("attempt", T.StringType())])
    return spark.read.schema(schema).parquet(f"{path}/rows") if _attempts(spark, path) else spark.createDataFrame([], schema)


def save(issues: DataFrame, path: str, run_date: str, run_id: str, reports: list[str] | None = None) -> str:
    """Writes the run's issues (report, ...) and then makes it the current one of its reports; returns the attempt.

    `reports` names those that ran, also the ones that found nothing.
    """
    spark, attempt = issues.sparkSession, uuid.uuid4().hex
    issues.withColumn("attempt", F.lit(attempt)).write.partitionBy("report", "attempt").mode("append").parquet(f"{path}/rows")
    complete = _rows(spark, path, issues.schema).where(F.col("attempt") == attempt).groupBy("report").agg(F.count("*").alias("n_rows"))
    if reports:
        complete = complete.join(spark.createDataFrame([(r,) for r in dict.fromkeys(reports)], "report string"), "report", "full")
    before = runs(spark, path).groupBy("report").agg(F.max("seq").alias("seq"))
    rows = complete.join(before, "report", "left").select(
        "report", (F.coalesce("seq", F.lit(0)) + 1).alias("seq"), F.lit(attempt).alias("attempt"), F.lit(run_date).alias("run_date"), F.lit(run_id).alias("run_id"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.lit(issues.schema.json()).alias("columns"), F.current_timestamp().alias("saved_at"),
    )
    rows.coalesce(1).write.mode("append").parquet(f"{path}/runs")
    return attempt


def read(spark: SparkSession, path: str, keep: int = 1) -> DataFrame:
    """Issues of the last `keep` runs of each report, with run_date and run_id; only folders of those are read."""
    known = current(spark, path, keep)
    rows = known.select("attempt", "columns", "saved_at").distinct().orderBy(F.desc("saved_at")).collect()  # a few for each report
    columns = T.StructType.fromJson(json.loads(rows[0].columns)) if rows else T.StructType()
    met = _rows(spark, path, columns).where(F.col("attempt").isin([r.attempt for r in rows]))
    return met.join(F.broadcast(known.select("report", "attempt", "run_date", "run_id")), ["report", "attempt"]).drop("attempt")


def _attempts(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(report, attempt) of every folder of rows."""
    files, folder = _files(spark, f"{path}/rows/report=*/attempt=*")
    unescape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    names = [(s.getPath().getParent().getName(), s.getPath().getName()) for s in (files.globStatus(folder) or [])]
    return [(unescape(a.split("=", 1)[1]), b.split("=", 1)[1]) for a, b in names]


def prune(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Removes the rows of all attempts but those of the last `keep` runs of each report; returns how many."""
    kept = {(r.report, r.attempt) for r in current(spark, path, keep).select("report", "attempt").collect()}
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    old = [pair for pair in _attempts(spark, path) if pair not in kept]
    for report, attempt in old:
        files, folder = _files(spark, f"{path}/rows/report={escape(report)}/attempt={attempt}")
        files.delete(folder, True)
    return len(old)


def master(issues: DataFrame) -> DataFrame:
    """(report, issues, critical, important, urls): the line of each report in the book over all of them."""
    grave = lambda s: F.count_if(F.col("severity") == s)
    return issues.groupBy("report").agg(F.count("*").alias("issues"), grave("Critical").alias("critical"), grave("Important").alias("important"), F.count_distinct("url").alias("urls"))
