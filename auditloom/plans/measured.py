"""Reports of measurements, laid over the events: a user is a page, an event its measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators import measured as M

from .registry import query, table
from .resources import one_of, sql_one_of

NAMES = ["Performance", "Accessibility", "Best Practices", "SEO"]
MODES, AUDITS = ["binary", "numeric", "manual", "metricSavings"], ["is-crawlable", "color-contrast", "uses-http2", "lcp", "meta-description"]


@query("""WITH e AS (SELECT event_id AS url, (event_id % 97) * 60 AS lcp, (event_id % 13) * 50 AS inp, CASE WHEN event_id % 11 < 9 THEN (event_id % 11) / 25 END AS cls, (event_id % 19) * 120 AS ttfb FROM events),
m AS (SELECT url, 'LCP' AS name, lcp AS v, 2500 AS good, 4000 AS poor, true AS core FROM e UNION ALL SELECT url, 'INP', inp, 200, 500, true FROM e UNION ALL SELECT url, 'CLS', cls, 0.1, 0.25, true FROM e UNION ALL SELECT url, 'TTFB', ttfb, 800, 1800, false FROM e)
SELECT url, CASE WHEN v > poor AND core THEN 'Critical' WHEN v > poor OR core THEN 'Important' ELSE 'Optimization' END AS severity, name || CASE WHEN v > poor THEN ' poor' ELSE ' needs improvement' END AS issue,
CASE WHEN name = 'CLS' THEN printf('%.3f', v) WHEN v >= 1000 THEN printf('%.2f s', v / 1000) ELSE printf('%.0f ms', v) END AS current_value FROM m WHERE v > good""")
def report_core_vitals(spark, sf_dir):
    """Report 12a: metrics of pages that are not good."""
    n = F.col("event_id")
    metrics = table(spark, sf_dir, "events").select(n.alias("url"), (n % 97 * 60).alias("lcp"), (n % 13 * 50).alias("inp"), F.when(n % 11 < 9, n % 11 / 25).alias("cls"), (n % 19 * 120).alias("ttfb"))
    return M.vitals_rules(metrics).select("url", "severity", "issue", "current_value")


@query(f"""WITH a AS (SELECT event_id, user_id AS url, (event_id % 4) AS c, {sql_one_of(AUDITS, "event_id // 4")} AS audit, (event_id % 21) / 20 AS score, {sql_one_of(MODES, "event_id // 3")} AS mode, CASE WHEN event_id % 2 = 0 THEN 'metrics' END AS grp FROM events),
f AS (SELECT url, audit, min_by((c, score, mode, grp), (c, score, mode, grp)) AS m FROM (SELECT url, audit, c, score, mode, coalesce(grp, '') AS grp FROM a WHERE score < 0.9 AND mode <> 'manual') GROUP BY 1, 2),
r AS (SELECT url, audit, m[1] AS c, m[2] AS score, m[3] AS mode, m[4] AS grp FROM f)
SELECT url, CASE WHEN audit = 'is-crawlable' THEN 'Critical' WHEN c IN (1, 3) OR (grp = 'metrics' AND score < 0.5) OR (c = 2 AND mode = 'binary') THEN 'Important' ELSE 'Optimization' END AS severity,
'Lighthouse ' || {sql_one_of(NAMES, "c")} AS category, 'Lighthouse: ' || audit AS issue, CASE WHEN mode = 'binary' THEN 'failed' ELSE 'score ' || round(score * 100)::INTEGER END AS current_value FROM r""")
def report_lighthouse(spark, sf_dir):
    """Report 12b: failed audits of pages, each once."""
    n = F.col("event_id")
    audits = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("url"), one_of(list(M.CATEGORIES), n).alias("category_id"), one_of(NAMES, n).alias("category"), one_of(AUDITS, F.floor(n / 4)).alias("audit"), F.lit(None).cast("string").alias("title"), (n % 21 / 20).alias("score"),
        one_of(MODES, F.floor(n / 3)).alias("mode"), F.when(n % 2 == 0, "metrics").otherwise("").alias("group"), F.lit("").alias("shown"), F.lit(None).cast("string").alias("details"),
    )
    return M.lighthouse_rules(audits).select("url", "severity", "category", "issue", "current_value")


@query(f"""WITH s AS (SELECT event_id AS url, {sql_one_of(NAMES, "event_id")} AS c, (event_id % 101)::INTEGER AS score FROM events)
SELECT url, 'Lighthouse ' || c || CASE WHEN score < 50 THEN ' score poor' ELSE ' score needs improvement' END AS issue, score || ' / 100' AS current_value FROM s WHERE score < 90""")
def category_issues(spark, sf_dir):
    """Categories of pages with too low a score."""
    n = F.col("event_id")
    return M.category_rules(table(spark, sf_dir, "events").select(n.alias("url"), one_of(NAMES, n).alias("category"), (n % 101).cast("int").alias("score"))).select("url", "issue", "current_value")
