"""Numeric facts: medians, ratings, top rows, interval unions, latest rows. Events stand in for measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions import text as T
from auditloom.operators import metrics

from .registry import query, table


@query("SELECT event_type, median(value)::DOUBLE AS value FROM events GROUP BY 1")
def median_metric(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.median("value").alias("value"))


@query("WITH l AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY 1) SELECT event_type, v[len(v) // 2 + 1] AS value FROM l")
def upper_median(spark, sf_dir):
    return metrics.upper_median(table(spark, sf_dir, "events"), "event_type", "value")


@query("WITH l AS (SELECT user_id, list_reverse_sort(list(value)) AS v FROM events GROUP BY 1) SELECT user_id, v[least(len(v), len(v) // 50 + 1)] AS value FROM l")
def inp_rank(spark, sf_dir):
    return metrics.slowest_but(table(spark, sf_dir, "events"), "user_id", "value")


@query("SELECT event_type, CASE WHEN value IS NULL THEN 'n/a' WHEN value <= 20 THEN 'Good' WHEN value > 60 THEN 'Poor' ELSE 'Needs improvement' END AS rating, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def rating(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", T.rate(F.col("value"), 20, 60).alias("rating")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem)
SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, rn::INTEGER AS rn FROM r WHERE rn <= 15""")
def top15_per_group(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return metrics.top_per_group(rows, "l_suppkey", [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 15)


@query("""WITH s AS (SELECT user_id, epoch_us(ts) AS a, epoch_us(ts) + (value * 1000000 * 600)::BIGINT AS b FROM events),
w AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)
SELECT user_id, sum(greatest(0, b - greatest(a, coalesce(reach, a))))::BIGINT AS covered FROM w GROUP BY 1""")
def interval_union(spark, sf_dir):
    """Microseconds that each user's events cover, each lasting ten minutes for every unit of value."""
    start = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    rows = table(spark, sf_dir, "events").select("user_id", start.alias("a"), (start + F.round(F.col("value") * 1000000 * 600).cast("long")).alias("b"))
    return metrics.interval_union(rows, "user_id", "a", "b")


@query("SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def latest_per_key(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    top = rows.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m"))
    return top.select("o_custkey", F.col("m.o_orderkey").alias("o_orderkey"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM c)
SELECT user_id, event_type FROM r WHERE rn = 1""")
def mode_per_group(spark, sf_dir):
    return metrics.mode_per_group(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def anti_unmatched(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(urgent, "c_custkey", "left_anti")


@query("""SELECT event_type, count(*)::BIGINT AS requests, count(DISTINCT user_id)::BIGINT AS users, sum(value) FILTER (value > 0)::DOUBLE AS total, count(*) FILTER (value > 50)::BIGINT AS slow,
min(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS least_k FROM events GROUP BY 1""")
def domain_rollup(spark, sf_dir):
    """Requests, distinct users, totals and slow ones of each kind: one partial aggregation."""
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return rows.groupBy("event_type").agg(
        F.count("*").alias("requests"), F.count_distinct("user_id").alias("users"), F.sum(F.when(F.col("value") > 0, F.col("value"))).alias("total"),
        F.count_if(F.col("value") > 50).alias("slow"), F.min("k").alias("least_k"),
    )


@query("SELECT user_id, sum(CAST(value - 50 AS DECIMAL(20, 6)))::DOUBLE AS tbt FROM events WHERE value > 50 GROUP BY 1")
def blocking_time(spark, sf_dir):
    """What exceeds 50 of each measurement, summed for each user; decimal, so that the order of rows does not matter."""
    over = (F.col("value") - 50).cast("decimal(20,6)")
    return table(spark, sf_dir, "events").where("value > 50").groupBy("user_id").agg(F.sum(over).cast("double").alias("tbt"))
