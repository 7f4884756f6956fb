"""Runs of reports: replaced, repeated, broken off, pruned."""

import pytest
from pyspark.sql import functions as F

from auditloom.operators import retention as R

SCHEMA = "report string, url string, severity string"


def issues(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def held(spark, path, keep=1):
    return sorted((r.report, r.url, r.run_id) for r in R.read(spark, path, keep).collect())


def test_runs_replace_and_prune(spark, tmp_path):
    path = str(tmp_path / "book")
    assert R.runs(spark, path).count() == 0 and R.read(spark, path).count() == 0 and R.prune(spark, path) == 0
    R.save(issues(spark, ("02", "a", "Info"), ("02", "b", "Critical"), ("03 / x=1", "a", "Info")), path, "2024-01-01", "r1")
    R.save(issues(spark, ("02", "c", "Info")), path, "2024-01-02", "r2", ["02", "07"])
    # a report that did not run keeps its earlier run, one that found nothing has a run without rows
    assert held(spark, path) == [("02", "c", "r2"), ("03 / x=1", "a", "r1")]
    assert {(r.report, r.run_id, r.n_rows, r.seq) for r in R.current(spark, path).collect()} == {("02", "r2", 1, 2), ("03 / x=1", "r1", 1, 1), ("07", "r2", 0, 1)}
    assert held(spark, path, 2) == [("02", "a", "r1"), ("02", "b", "r1"), ("02", "c", "r2"), ("03 / x=1", "a", "r1")]
    # the same run once more replaces itself
    R.save(issues(spark, ("02", "d", "Info")), path, "2024-01-02", "r2")
    assert held(spark, path, 2) == [("02", "a", "r1"), ("02", "b", "r1"), ("02", "d", "r2"), ("03 / x=1", "a", "r1")]
    assert R.prune(spark, path) == 2 and R.prune(spark, path) == 0
    assert held(spark, path) == [("02", "d", "r2"), ("03 / x=1", "a", "r1")]
    book = {r.report: (r.issues, r.critical, r.urls) for r in R.master(R.read(spark, path)).collect()}
    assert book == {"02": (1, 0, 1), "03 / x=1": (1, 0, 1)}


def test_a_run_that_breaks_off_leaves_the_old_one(spark, tmp_path):
    path = str(tmp_path / "book")
    R.save(issues(spark, ("02", "a", "Info")), path, "2024-01-01", "r1")
    broken = issues(spark, ("02", "b", "Info"), ("02", "c", "Info")).withColumn("url", F.when(F.col("url") == "c", F.raise_error(F.lit("stop"))).otherwise(F.col("url")))
    with pytest.raises(Exception, match="stop"):
        R.save(broken, path, "2024-01-02", "r2")
    assert held(spark, path) == [("02", "a", "r1")]
    # rows that were written before the driver stopped, without their line in the table of runs
    issues(spark, ("02", "z", "Info")).withColumn("attempt", F.lit("lost")).write.partitionBy("report", "attempt").mode("append").parquet(f"{path}/rows")
    assert held(spark, path) == [("02", "a", "r1")] and R.prune(spark, path) == 1 and held(spark, path) == [("02", "a", "r1")]
    R.save(issues(spark).limit(0), path, "2024-01-03", "r3", ["02"])
    assert held(spark, path) == [] and R.current(spark, path).first().n_rows == 0
    assert R.prune(spark, path) == 1 and held(spark, path) == [] and "url" in R.read(spark, path).columns
