"""Stateful streams: late rows, restarts from the checkpoint, and equality with the batch operators."""

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from auditloom.operators import scoring
from auditloom.streaming import incremental, stateful

ISSUE = "url string, issue string, current_value string, element string, ts timestamp"


@pytest.fixture
def store(spark):
    spark.conf.set(*stateful.STATE)
    yield
    spark.conf.unset(stateful.STATE[0])


def run(frame, folder, mode="append"):
    query = frame.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/marks").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None


def add(spark, folder, n, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{n}")


def source(spark, folder, schema):
    Path(folder, "in").mkdir(exist_ok=True)
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def stamp(minute):
    return f"2026-01-01 {minute // 60:02}:{minute % 60:02}:00"



def test_cap_over_batches_and_restarts(spark, store, tmp_path):
    folder = str(tmp_path)
    batches = [[("u", "i", f"v{k}", "e", stamp(0)) for k in range(4)] + [("u", "j", "x", "e", stamp(1))], [("u", "i", f"w{k}", "e", stamp(2)) for k in range(3)] + [("t", "i", "y", "e", stamp(3))]]
    text = ISSUE.replace("timestamp", "string")
    typed = lambda rows: spark.createDataFrame(rows, text).withColumn("ts", F.to_timestamp("ts"))
    stream = stateful.capped(source(spark, folder, ISSUE), cap=5, late="1 minute", after_ms=60 * 60_000)
    for n, rows in enumerate(batches):  # each batch is a run of its own, that starts from the checkpoint
        typed(rows).coalesce(1).write.parquet(f"{folder}/in/{n}")
        run(stream, folder)
    # a row of another key, hours later, moves the watermark: the keys before are closed
    for n, minute in ((7, 300), (8, 600)):
        typed([("z", "i", f"late{n}", "e", stamp(minute))]).coalesce(1).write.parquet(f"{folder}/in/{n}")
        run(stream, folder)
    # a row behind the watermark is left out
    typed([("u", "i", "too late", "e", stamp(1))]).coalesce(1).write.parquet(f"{folder}/in/9")
    run(stream, folder)
    got = Counter((r.url, r.issue, "more" if r.current_value.endswith("not listed") else "row", r.current_value.split()[0] if "more" in r.current_value else "") for r in spark.read.parquet(f"{folder}/out").where("url <> 'z'").collect())
    assert got == {("u", "i", "row", ""): 5, ("u", "i", "more", "2"): 1, ("u", "j", "row", ""): 1, ("t", "i", "row", ""): 1}
    batch = scoring.cap_issues(typed(sum(batches, [])).drop("ts").withColumn("report", F.lit("r")), cap=5)
    same = Counter((r.url, r.issue, r.current_value.endswith("not listed")) for r in batch.collect())
    assert same == Counter({(u, i, kind == "more"): n for (u, i, kind, _), n in got.items()})


def test_seen_set_over_restarts(spark, store, tmp_path):
    folder = str(tmp_path)
    schema = "url string, n int"
    stream = stateful.first_seen(source(spark, folder, schema), "url")
    for n, urls in enumerate(("aab", "bca", "ddc")):
        add(spark, folder, n, [(u, n) for u in urls], schema)
        run(stream, folder)
    assert sorted((r.url, r.n) for r in spark.read.parquet(f"{folder}/out").collect()) == [("a", 0), ("b", 0), ("c", 1), ("d", 2)]


def test_merge_keeps_the_newest_row_of_each_key(spark, tmp_path):
    path, schema = str(tmp_path / "table"), "k string, at int, v string"
    assert stateful.merged_table(spark, path) is None
    write = stateful.merge_latest("k", "at", path)
    frame = lambda rows: spark.createDataFrame(rows, schema)
    write(frame([("a", 1, "x"), ("b", 5, "x"), ("a", 2, "y"), (None, 9, "n")]), 0)
    write(frame([("a", 1, "old"), ("c", 1, "z"), ("b", 5, "w")]), 1)
    want = {("a", 2, "y"), ("b", 5, "x"), ("c", 1, "z")}
    now = lambda: {tuple(r) for r in stateful.merged_table(spark, path).collect()}
    assert now() == want
    write(frame([("a", 1, "old"), ("c", 1, "z"), ("b", 5, "w")]), 1)  # the batch runs again
    assert now() == want
    # a version that was not finished is not read, and is written anew
    frame([("a", 99, "half")]).write.parquet(f"{path}/version=2")
    (tmp_path / "table" / "version=2" / "_SUCCESS").unlink()
    assert now() == want
    write(frame([("d", 1, "q")]), 2)
    assert now() == want | {("d", 1, "q")}
    write(frame([]), 3)
    assert now() == want | {("d", 1, "q")} and not (tmp_path / "table" / "version=0").exists()


def test_upsert_of_a_stream(spark, tmp_path):
    folder = str(tmp_path)
    schema = "k string, at int, v string"
    for n in range(3):
        add(spark, folder, n, [("a", n, f"v{n}"), (f"k{n}", 0, "x")], schema)
        query = source(spark, folder, schema).writeStream.foreachBatch(incremental.upsert_latest("k", "at", f"{folder}/table")).option("checkpointLocation", f"{folder}/marks").trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert {tuple(r) for r in stateful.merged_table(spark, f"{folder}/table").collect()} == {("a", 2, "v2"), ("k0", 0, "x"), ("k1", 0, "x"), ("k2", 0, "x")}
