"""Issues from what browsers measured: core vitals and Lighthouse audits, as tables of one row for each measurement.

Defined cases: a measurement that is null raises nothing, an audit that several categories share counts in the first of
them, scores are shares of one for audits and whole numbers up to 100 for categories.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import classify as C
from auditloom.functions import text as T

from .element_rules import COLUMNS
from .rules import Rule, evaluate
from .run_facts import failing_items

#: Shown name of each metric and its bounds of good and poor (milliseconds, a ratio for cls).
VITALS = {"lcp": ("LCP", 2500, 4000), "inp": ("INP", 200, 500), "cls": ("CLS", 0.1, 0.25), "fcp": ("FCP", 1800, 3000), "ttfb": ("TTFB", 800, 1800), "tbt": ("TBT", 200, 600), "si": ("Speed Index", 3400, 5800)}
#: Categories of audits in their order, modes that have a score, audits that keep a page out of an index.
CATEGORIES = ("performance", "accessibility", "best-practices", "seo")
SCORED, BLOCKS_INDEXING, PASSES = ("binary", "numeric", "metricSavings"), ("is-crawlable", "http-status-code", "robots-txt", "canonical"), 0.9


def vitals(metrics: DataFrame) -> DataFrame:
    """(url, metric, value, rating) of a table with a column for each metric, one row for each metric that was measured."""
    known = [m for m in VITALS if m in metrics.columns]
    each = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), T.rate(F.col(m), *VITALS[m][1:]).alias("rating")) for m in known]
    return metrics.select("url", F.explode(F.array(*each)).alias("x")).select("url", "x.*").where("value IS NOT NULL")


def vitals_rules(metrics: DataFrame) -> DataFrame:
    """An issue for each metric of a page that is not good; the three core ones are graver."""
    core = F.col("metric").isin("lcp", "inp", "cls")
    rules = []
    for metric, (name, _, _) in VITALS.items():
        own = F.col("metric") == metric
        shown = C.vitals_shown(F.col("metric"), F.col("value"))
        for rating in ("Poor", "Needs improvement"):
            hit = own & (F.col("rating") == rating)
            severity = {("Poor", True): "Critical", ("Poor", False): "Important", ("Needs improvement", True): "Important"}
            for is_core, guard in ((True, core), (False, ~core)):
                category = "Core Web Vitals" if is_core else "Supporting metrics"
                rules.append(Rule(severity.get((rating, is_core), "Optimization"), category, f"{name} {rating.lower()}", hit & guard, shown))
    return evaluate(vitals(metrics), rules).select(*COLUMNS)


def _count(total: Column) -> Column:
    return F.when(total > 0, F.concat(F.lit(" ("), total.cast("string"), F.when(total == 1, " item)").otherwise(" items)"))).otherwise("")


def lighthouse_rules(audits: DataFrame) -> DataFrame:
    """An issue for each failed audit (url, category_id, category, audit, title, score, mode, group, shown, details).

    `shown` is the engine's own text of the value and `details` its JSON. Issue names come from the data, so severities
    are columns here instead of rules.
    """
    order = F.coalesce(F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category_id")), F.lit(0))
    failed = audits.where((F.col("score") < PASSES) & F.col("mode").isin(*SCORED))
    rest = ["category_id", "category", "title", "score", "mode", "group", "shown", "details"]
    once = failed.groupBy("url", "audit").agg(F.min(F.struct(order.alias("o"), *rest)).alias("m")).select("url", "audit", *[f"m.{c}" for c in rest])
    binary = F.col("mode") == "binary"
    grave = F.col("category_id").isin("accessibility", "seo") | ((F.col("group") == "metrics") & (F.col("score") < 0.5)) | ((F.col("category_id") == "best-practices") & binary)
    severity = F.when(F.col("audit").isin(*BLOCKS_INDEXING), "Critical").when(F.coalesce(grave, F.lit(False)), "Important").otherwise("Optimization")
    rows = once.withColumn("f", failing_items(F.col("details")))
    value = F.coalesce(F.nullif("shown", F.lit("")), F.when(binary, "failed").otherwise(F.concat(F.lit("score "), F.round(F.col("score") * 100).cast("int"))))
    return rows.select(
        "url", severity.alias("severity"), F.concat(F.lit("Lighthouse "), "category").alias("category"), F.concat(F.lit("Lighthouse: "), F.coalesce("title", "audit")).alias("issue"),
        F.concat(value, _count(F.col("f.total"))).alias("current_value"), F.array_join("f.labels", "; ").alias("element"),
    )


def category_rules(scores: DataFrame) -> DataFrame:
    """An issue for each category (url, category, score) below 50 or 90 of 100."""
    s, name = F.col("score"), F.concat(F.lit("Lighthouse "), "category")
    low = scores.where(s < 90).withColumn("poor", s < 50)
    severity = F.when(F.col("poor"), "Important").otherwise("Optimization")
    issue = F.concat(name, F.when(F.col("poor"), " score poor").otherwise(" score needs improvement"))
    return low.select("url", severity.alias("severity"), name.alias("category"), issue.alias("issue"), F.concat(s, F.lit(" / 100")).alias("current_value"), F.lit("").alias("element"))
