"""From issue rows to scores, roll-ups, a checklist and a verdict.

Issues have columns url, severity, category, issue, current_value, element, report. Everything is grouped
sums and joins on small dimension tables; nothing orders the issues globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.functions.text import grade

from .rules import SITE_WIDE, page_weight, rank, site_weight

CAP = 50


def deductions(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """(url, deduction): a repeated problem on one page counts once."""
    once = issues.select("url", "severity", "issue").distinct()
    return once.join(pages.select("url").distinct(), "url", "left_semi").groupBy("url").agg(F.sum(page_weight(F.col("severity"))).alias("deduction"))


def page_scores(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """(url, score, grade) of every page; a page without issues has 100."""
    joined = pages.select("url").distinct().join(deductions(pages, issues), "url", "left")
    score = F.greatest(F.lit(0), 100 - F.coalesce("deduction", F.lit(0))).cast("double")
    return joined.select("url", score.alias("score")).withColumn("grade", grade(F.col("score")))


def report_score(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """One row (score, grade): mean page score less what site-level checks take, at most 60.

    An issue whose url is not a page is site-level and counts once for each distinct check.
    """
    site = issues.join(pages.select("url").distinct(), "url", "left_anti").select("severity", "issue").distinct()
    taken = site.agg(F.least(F.lit(60), F.coalesce(F.sum(site_weight(F.col("severity"))), F.lit(0))).alias("taken"))
    mean = page_scores(pages, issues).agg(F.coalesce(F.avg("score"), F.lit(100.0)).alias("mean"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(F.col("mean") - F.col("taken"), 1)))
    return mean.join(F.broadcast(taken)).select(score.alias("score")).withColumn("grade", grade(F.col("score")))


def cap_issues(issues: DataFrame, cap: int = CAP) -> DataFrame:
    """At most `cap` rows for each url and check, and one more that says how many are left out.

    Rows are kept in the order of current value and element.
    """
    first = F.row_number().over(Window.partitionBy("url", "issue").orderBy("current_value", "element"))
    # the rows of a key are cut to cap + 1 before the shuffle, and their number is a partial sum, so no key fills a task
    rows = issues.withColumn("nth", first).where(F.col("nth") <= cap + 1)
    many = issues.groupBy(F.col("url").alias("k_url"), F.col("issue").alias("k_issue")).agg(F.count("*").alias("n")).where(F.col("n") > cap)
    rows = rows.join(many, F.col("url").eqNullSafe(F.col("k_url")) & F.col("issue").eqNullSafe(F.col("k_issue")), "left")
    over = F.col("nth") == cap + 1
    value = F.when(over, F.concat((F.col("n") - cap).cast("string"), F.lit(" more occurrences not listed"))).otherwise(F.col("current_value"))
    return rows.withColumns({"current_value": value, "element": F.when(over, "").otherwise(F.col("element"))}).select(*issues.columns)


def issue_types(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity", "category", "issue").agg(F.count_distinct("url").alias("pages"), F.count("*").alias("occurrences"))


def url_summary(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """Counts by severity of every checked page and of every url with issues."""
    s = F.col("severity")
    counts = issues.groupBy("url").agg(F.count_if(s == "Critical").alias("critical"), F.count_if(s == "Important").alias("important"), F.count_if(s == "Optimization").alias("optimization"), F.count("*").alias("total"))
    joined = pages.select("url").distinct().join(counts, "url", "full_outer")
    return joined.select("url", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("critical", "important", "optimization", "total")])


def issue_id(report: Column, url: Column, issue: Column, current: Column, element: Column) -> Column:
    """A stable id: the report's key and ten hex digits of an md5 of the key and the issue's identity."""
    raw = F.concat(report, F.concat_ws("|", url, issue, current, element))
    return F.concat(report, F.lit("-"), F.left(F.md5(raw.cast("binary")), F.lit(10)))


def merge_reports(issues: DataFrame) -> DataFrame:
    """The same problem found by several reports as one row, with the gravest severity and the reports' names.

    Problems are the same if url, issue, current value, element and, where the issues have them, details agree."""
    details = ["details"] if "details" in issues.columns else []
    merged = issues.groupBy("url", F.lower(F.trim("issue")).alias("key"), "current_value", "element", *details).agg(
        F.min(F.struct(rank(F.col("severity")).alias("rank"), "severity", "issue")).alias("top"), F.array_sort(F.collect_set("report")).alias("reports")
    )
    return merged.select("url", "top.issue", "top.severity", "current_value", F.array_join("reports", ", ").alias("reported_by"))


def category_scores(categories: DataFrame, report_scores: DataFrame) -> DataFrame:
    """(category, weight, score, grade) from (category, weight, report) and (report, score); null if not measured."""
    joined = categories.join(report_scores, "report", "left")
    return joined.groupBy("category", "weight").agg(F.round(F.avg("score"), 1).alias("score")).withColumn("grade", grade(F.col("score")))


def health_score(scores: DataFrame) -> DataFrame:
    """One row (overall, grade): the weighted mean over measured categories only."""
    measured = scores.where("score IS NOT NULL")
    total = measured.agg(F.round(F.sum(F.col("score") * F.col("weight")) / F.sum("weight"), 1).alias("overall"))
    return total.withColumn("grade", grade(F.col("overall")))


def _finds(pattern: Column, text: Column) -> Column:
    """Case-insensitive search; a missing pattern accepts everything."""
    return pattern.isNull() | F.coalesce(F.regexp_like(F.lower(text), pattern), F.lit(False))


def checklist(checks: DataFrame, sources: DataFrame, issues: DataFrame, ran: DataFrame, human: DataFrame, server: str = "") -> DataFrame:
    """(id, auto_status, status, n_matched, pages) of every check.

    checks: id, kind, fails (severities that fail it); sources: id, report, issue_re, category_re, exclude_re;
    ran: report; human: id, status, server. A check with no report run, or whose sources could only not be
    checked, is SKIP; a human result for this server overrides. A failure to load a page counts only where the
    issue is asked for by name.
    """
    broken = F.regexp_like(F.lower("issue"), F.lit("page not reachable|failed to load"))
    sources = F.broadcast(sources.withColumnRenamed("report", "src_report"))
    hits = issues.join(sources, F.col("report") == F.col("src_report"))
    hits = hits.where((F.col("issue_re").isNotNull() | ~broken) & _finds(F.col("issue_re"), F.col("issue")) & _finds(F.col("category_re"), F.col("category")))
    hits = hits.where(F.col("exclude_re").isNull() | ~_finds(F.col("exclude_re"), F.col("issue"))).dropDuplicates(["id", "url", "issue", "current_value", "element"])
    undone = F.col("issue").startswith("Not checked:")
    counted = ~undone & (F.col("severity") != "Info")
    found = hits.groupBy("id").agg(
        F.count_if(counted).alias("n_matched"), F.count_if(undone).alias("n_undone"), F.min(F.when(counted, rank(F.col("severity")))).alias("worst"),
        F.count_distinct(F.when(counted & (F.col("url") != SITE_WIDE), F.col("url"))).alias("pages"),
    )
    available = sources.join(ran, F.col("src_report") == ran["report"], "left_semi").groupBy("id").agg(F.count("*").alias("n_ran"))
    rows = checks.join(found, "id", "left").join(available, "id", "left").na.fill(0, ["n_matched", "n_undone", "pages", "n_ran"])
    names = F.array(F.lit("Critical"), F.lit("Important"), F.lit("Optimization"))
    worst = F.try_element_at(names, F.coalesce("worst", F.lit(9)) + 1)
    auto = (
        F.when(F.col("kind") == "HUMAN", "HUMAN").when(F.col("n_ran") == 0, "SKIP")
        .when(F.col("n_matched") > 0, F.when(F.array_contains("fails", worst), "FAIL").otherwise("WARN")).when(F.col("n_undone") > 0, "SKIP").otherwise("PASS")
    )
    said = human.where((F.coalesce("server", F.lit("")) == "") | (F.lit(server) == "") | (F.col("server") == server)).select("id", F.upper("status").alias("said"))
    rows = rows.withColumn("auto_status", auto).join(said, "id", "left")
    return rows.select("id", "auto_status", F.coalesce("said", "auto_status").alias("status"), F.col("n_matched").cast("long").alias("n_matched"), F.col("pages").cast("long").alias("pages"))


def verdict(results: DataFrame) -> DataFrame:
    s = F.col("status")
    counts = results.agg(*[F.count_if(s == x).alias(x.lower()) for x in ("FAIL", "WARN", "SKIP", "HUMAN", "PASS")])
    v = F.when(F.col("fail") > 0, "NEEDS FIXES").when(F.col("warn") + F.col("skip") + F.col("human") > 0, "REVIEW").otherwise("READY")
    return counts.withColumn("verdict", v)


def first_match(rows: DataFrame, text: str, rules: DataFrame, out: str) -> DataFrame:
    """Each row with `out` of the first rule (ord, pattern, out) whose pattern occurs in it; null if none does.

    The rules are a small dimension table; the distinct texts are matched once each and joined back.
    """
    texts = rows.select(text).distinct()
    hit = texts.join(F.broadcast(rules), F.regexp_like(F.lower(F.col(text)), F.col("pattern")))
    best = hit.groupBy(text).agg(F.min(F.struct("ord", out)).alias("b")).select(text, F.col(f"b.{out}").alias(out))
    return rows.join(best, text, "left")


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small dimension table."""
    return spark.createDataFrame(rows, schema)
