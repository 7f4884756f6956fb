"""Pages met with collected facts: crawl records, statuses of targets, probed files, what the project expects.

All are equi-joins on a url in its equality form, so Spark shuffles by url and splits hot ones; lists of pages are
first-N by a partial aggregate of the smallest. Issue columns are those of `element_rules`.

Defined cases: a target without a fact is reported by no rule on its status. Facts that repeat a url are reduced to
one row, the worst status first. Empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import classify as C
from auditloom.functions import urls as U

from .element_rules import COLUMNS
from .rules import SITE_WIDE, Rule, evaluate


def _worst(statuses: DataFrame) -> DataFrame:
    """(at, status, hops, is_loop) of (url, status, hops, is_loop): one row for each url, failures first."""
    bad = F.when((F.col("status") == 0) | (F.col("status") >= 400), 1).otherwise(0)
    top = F.max(F.struct(bad.alias("bad"), "status", "hops", F.coalesce("is_loop", F.lit(False)).alias("is_loop")))
    return statuses.groupBy(U.norm(F.col("url")).alias("at")).agg(top.alias("t")).select("at", "t.status", "t.hops", "t.is_loop")


def eligible_pages(records: DataFrame, only_sitemap: bool = False) -> DataFrame:
    """Crawl records that count as pages: HTML with status 200, in the sitemap or not naming another url as their canonical one.

    A missing or empty canonical, and one that is the same url in its equality form, name no other. With
    `only_sitemap`, pages of the sitemap alone.
    """
    canonical = F.coalesce(F.col("canonical"), F.lit(""))
    itself = (canonical == "") | (U.norm(canonical) == U.norm(F.col("url")))
    listed = F.coalesce(F.col("in_sitemap"), F.lit(False))
    return records.where(F.col("is_html") & (F.col("status") == 200) & (listed if only_sitemap else listed | itself))


def crawl_statistics(records: DataFrame) -> DataFrame:
    """One row of counts: urls, pages, redirects, errors, blocked, in the sitemap, only by JavaScript; mean ms; deepest."""
    s = F.col("status")
    return records.agg(
        F.count("*").alias("urls"), F.count_if(F.col("is_html") & (s == 200)).alias("pages"), F.count_if(s.between(300, 399)).alias("redirects"), F.count_if((s == 0) | (s >= 400)).alias("errors"),
        F.count_if("robots_blocked").alias("blocked"), F.count_if("in_sitemap").alias("in_sitemap"), F.count_if("js_only").alias("js_only"), F.round(F.avg("ms"), 0).cast("long").alias("mean_ms"), F.max("depth").alias("deepest"),
    )


def with_records(issues: DataFrame, records: DataFrame) -> DataFrame:
    """The issues with http_status and in_sitemap (yes or no) of their page's crawl record; empty without a record."""
    known = records.groupBy(U.clean(F.col("url")).alias("at")).agg(F.max(F.struct("status", "in_sitemap")).alias("r"))
    joined = issues.join(known, U.clean(F.col("url")) == F.col("at"), "left").drop("at")
    status, sitemap = F.coalesce(F.col("r.status").cast("string"), F.lit("")), F.when(F.col("r.in_sitemap"), "yes").when(F.col("r").isNotNull(), "no").otherwise("")
    return joined.withColumns({"http_status": status, "in_sitemap": sitemap}).drop("r")


def link_status_rules(links: DataFrame, statuses: DataFrame) -> DataFrame:
    """Issues of every page that links to a broken, looping or redirected target: each source, not one for each target.

    links: url, kind, target_url, label (`report_rules.labelled_links`); statuses: url, status, hops, is_loop.
    """
    once = links.where(F.col("kind").isin("internal", "external")).groupBy("url", "kind", "target_url").agg(F.min(F.struct("ord", "label")).alias("f"))
    met = once.join(_worst(statuses), U.norm(F.col("target_url")) == F.col("at"))
    broken, internal = (F.col("status") == 0) | (F.col("status") >= 400), F.col("kind") == "internal"
    result = C.internal_result(F.col("is_loop"), F.col("status"), F.coalesce("hops", F.lit(0)))
    severity, outcome = C.external_status(F.col("status"))
    to = F.concat("target_url", F.lit(" -> HTTP "), "status")
    element = F.concat(F.lit("<a> '"), F.left("f.label", F.lit(80)), F.lit("'"))
    grave = F.coalesce((F.col("status") == 0) | (F.col("status") >= 500), F.lit(False))
    return evaluate(met, [
        Rule("Critical", "Internal links", "Redirect loop", internal & (result == "loop"), to, element),
        Rule("Critical", "Internal links", "Broken internal link", internal & (result == "broken") & grave, to, element),
        Rule("Important", "Internal links", "Broken internal link", internal & (result == "broken") & ~grave, to, element),
        Rule("Important", "Internal links", "Internal link redirect chain", internal & (result == "chain"), to, element),
        Rule("Optimization", "Internal links", "Internal link redirects", internal & (result == "redirect"), to, element),
        Rule("Important", "External links", "Broken external link", ~internal & (outcome == "broken") & broken, to, element),
    ]).select(*COLUMNS)


def redirect_sources(hops: DataFrame, links: DataFrame) -> DataFrame:
    """(url, source): the target of each redirect inherits the pages that link to what redirects to it."""
    inbound = links.select("url", U.norm(F.col("target_url")).alias("at")).distinct()
    chains = hops.select(U.norm(F.col("url")).alias("from"), F.col("final_url").alias("target"))
    return inbound.join(chains, F.col("at") == F.col("from")).select(F.col("target").alias("url"), F.col("url").alias("source")).distinct()


def target_rules(pairs: DataFrame, statuses: DataFrame, severity: str, category: str, issue: str) -> DataFrame:
    """The issue for every (url, target) whose target is stored with another status than 200: canonicals, alternates, icons, files."""
    met = pairs.join(_worst(statuses), U.norm(F.col("target")) == F.col("at"))
    return evaluate(met, [Rule(severity, category, issue, F.col("status") != 200, F.concat("target", F.lit(" -> HTTP "), "status"), F.col("target"))]).select(*COLUMNS)


def file_fan_out(uses: DataFrame, probes: DataFrame, most: int = 50) -> DataFrame:
    """(src, status, pages, examples) of used files (page, src) that fail: all pages counted, the `most` first named."""
    bad = probes.where((F.col("status") == 0) | (F.col("status") >= 400)).groupBy("src").agg(F.max("status").alias("status"))
    pages = uses.select("src", "page").distinct().join(bad, "src")
    top = pages.withColumn("nth", F.row_number().over(_by_page())).where(F.col("nth") <= most)
    named = top.groupBy("src").agg(F.array_sort(F.collect_list("page")).alias("examples"))
    return pages.groupBy("src", "status").agg(F.count("*").alias("pages")).join(named, "src").select("src", "status", "pages", "examples")


def _by_page():
    from pyspark.sql import Window

    return Window.partitionBy("src").orderBy("page")


def absent(expected: DataFrame, found: DataFrame, key: Column, severity: str, category: str, issue: str) -> DataFrame:
    """A site-wide issue for every expected value (value) that is not among the found ones (value) by `key`.

    Confirmed telephone numbers and addresses, social profiles, footer links, main sections, preconnects, fonts.
    """
    have = found.select(key.alias("k")).where("k IS NOT NULL").distinct()
    missing = expected.withColumn("k", key).join(have, "k", "left_anti").select(F.lit(SITE_WIDE).alias("url"), "value")
    return evaluate(missing, [Rule(severity, category, issue, F.lit(True), F.col("value"))]).select(*COLUMNS)


def lost(live: DataFrame, dev: DataFrame, kinds: tuple[str, ...] = ("types", "phones", "h2")) -> DataFrame:
    """(path, kind, value): what a live page (path and arrays) shows and the page of the same path on the new server lacks."""
    spread = lambda side: side.select("path", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("v")) for k in kinds])).alias("x")).select("path", "x.kind", F.explode("x.v").alias("value")).distinct()
    both = spread(live).join(dev.select("path").distinct(), "path", "left_semi")
    return both.join(spread(dev), ["path", "kind", "value"], "left_anti")
