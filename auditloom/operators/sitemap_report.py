"""The sitemap report: what sitemaps, robots files and crawl records say of a site, as issues of their urls.

Rules that look at one row are one projection (`rules.evaluate`). Repeated urls and spellings are grouped by the url;
facts of a site are counted with partial sums; hosts of a site are a set of at most as many as are reported.

Defined cases: an entry without a loc is reported by nothing. Two equal entries have their dates checked once. Nulls in
marks of a record are false, a null status is a url that was never fetched, which no rule reports. A canonical url that
differs from its page by nothing but the host is an issue of the site. Empty tables give empty results, extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import urls as U
from auditloom.functions.classify import w3c_date

from .rules import SITE_WIDE, Rule, evaluate

COLUMNS = ("url", "severity", "category", "issue", "current_value", "element")
#: Answers that redirect, and the most urls and bytes of one sitemap.
REDIRECTS = (301, 302, 303, 307, 308)
MOST_URLS, MOST_BYTES = 50_000, 50 * 1024 * 1024
#: Hosts that only a developer reaches.
LOCAL = r"^(localhost|127\.|0\.0\.0\.0|10\.|192\.168\.|\[::1\])|\.(local|test|internal)(:\d+)?$"


def _together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(*COLUMNS) for p in parts])


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def entry_rules(entries: DataFrame, now: Column | None = None) -> DataFrame:
    """Issues of (loc, lastmod), the entries of all sitemaps with duplicates kept; `now` is the present time by default."""
    listed = entries.where("loc IS NOT NULL").select("loc", "lastmod")
    counts = listed.groupBy(F.col("loc").alias("url")).agg(F.count("*").alias("n"))
    repeated = evaluate(counts, [Rule("Important", "Sitemap", "Duplicate URL in sitemap", F.col("n") > 1, F.concat(F.lit("listed "), "n", F.lit(" times")))])
    before = F.lag("url").over(Window.partitionBy(F.lower("url")).orderBy("url"))
    spelled = evaluate(counts.withColumn("before", before), [Rule("Important", "Sitemap", "Same URL with different letter case", F.col("before").isNotNull(), F.col("url"), F.concat(F.lit("also listed as "), "before"))])
    given = F.coalesce("lastmod", F.lit("")) != ""
    at = w3c_date(F.col("lastmod"))
    dates = [
        Rule("Optimization", "Sitemap", "Missing <lastmod>", ~given, F.lit("(none)")),
        Rule("Important", "Sitemap", "Invalid <lastmod> date", given & at.isNull(), F.col("lastmod")),
        Rule("Important", "Sitemap", "<lastmod> in the future", given & (at > (F.current_timestamp() if now is None else now)), F.col("lastmod")),
    ]
    return _together(repeated, spelled, evaluate(listed.distinct().withColumnRenamed("loc", "url"), dates))


def site_rules(entries: DataFrame) -> DataFrame:
    """Issues of each sitemap as a whole, from (sitemap, loc): how many urls, which hosts, whether https and public.

    The host of most urls is the sitemap's own, the least of these at a tie.
    """
    parts = entries.where("loc IS NOT NULL").groupBy("sitemap", U.host(F.col("loc")).alias("host"), U.scheme(F.col("loc")).alias("scheme")).agg(F.count_distinct("loc").alias("n"))
    hosts = parts.groupBy("sitemap", "host").agg(F.sum("n").alias("n"), F.max_by("scheme", F.struct("n", "scheme")).alias("scheme"))
    own = F.min_by(F.struct("host", "scheme"), F.struct(-F.col("n"), F.col("host")))
    names = F.array_join(F.array_sort(F.collect_set(F.nullif("host", F.lit("")))), ", ")
    sites = hosts.groupBy(F.col("sitemap").alias("url")).agg(F.sum("n").alias("n"), own.alias("own"), F.count_if(F.col("host") != "").alias("hosts"), names.alias("names"))
    where = F.concat(F.col("own.scheme"), F.lit("://"), F.col("own.host"))
    return evaluate(sites, [
        Rule("Critical", "Sitemap", "More than 50,000 URLs in one sitemap", F.col("n") > MOST_URLS, F.concat(F.col("n").cast("string"), F.lit(" URLs"))),
        Rule("Critical", "Sitemap", "Sitemap URLs point to a local/development host", F.rlike(F.col("own.host"), F.lit(LOCAL)), where),
        Rule("Critical", "Sitemap", "Sitemap URLs are not HTTPS", F.col("own.scheme") != "https", where),
        Rule("Important", "Sitemap", "Sitemap mixes hosts", F.col("hosts") > 1, F.col("names")),
    ]).select(*COLUMNS)


def file_rules(files: DataFrame) -> DataFrame:
    """Issues of the fetched sitemap files (url, status, content_type, body)."""
    kind, body = _text(F.col("content_type")), _text(F.col("body"))
    size = F.octet_length(body)
    usable = (F.col("status") == 200) & F.rlike(body, F.lit(r"(?i)<(\w+:)?(url|sitemap)\b"))
    root = F.regexp_extract(body, r"(?is)<(?:\w+:)?(?:urlset|sitemapindex)\b[^>]*>", 0)
    return evaluate(files, [
        Rule("Critical", "Sitemap", "sitemap.xml missing or invalid", ~F.coalesce(usable, F.lit(False)), F.when(F.col("status") == 200, "no <url> entries").otherwise(F.concat(F.lit("HTTP "), _text(F.col("status"))))),
        Rule("Critical", "Sitemap", "sitemap.xml has no sitemaps.org namespace", usable & (root != "") & ~F.contains(root, F.lit("http://www.sitemaps.org/schemas/sitemap/0.9")), F.left(root, F.lit(80))),
        Rule("Critical", "Sitemap", "sitemap.xml larger than 50 MB", usable & (size > MOST_BYTES), F.concat(F.floor(size / 1048576).cast("string"), F.lit(" MB"))),
        Rule("Important", "Sitemap", "sitemap.xml not served as XML", usable & ~F.contains(kind, F.lit("xml")), F.when(kind == "", "(no Content-Type)").otherwise(kind)),
    ]).select(*COLUMNS)


def robots_rules(robots: DataFrame, allowed: DataFrame, files: DataFrame) -> DataFrame:
    """Issues of the robots files (host, status, body).

    allowed: (host, path, allowed) as `sources.tables.robots_allowed` gives it, of which the path `/` is read; files:
    fetched sitemaps (url, status), by which declared ones are known to load.
    """
    home = allowed.where("path = '/'").groupBy("host").agg(F.bool_and("allowed").alias("open"))
    rows = robots.join(home, "host", "left").withColumns({"url": F.lit(SITE_WIDE), "body": _text(F.col("body")), "declared": F.regexp_extract_all("body", F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))})
    there = F.col("status") == 200
    missing = ~F.coalesce(there, F.lit(False))
    own = evaluate(rows, [
        Rule("Critical", "Robots.txt", "robots.txt missing", missing, F.concat(F.lit("HTTP "), F.coalesce("status", F.lit(0)).cast("string")), F.col("host")),
        Rule("Critical", "Robots.txt", "robots.txt blocks the homepage / whole site", there & ~F.col("open"), F.lit("Disallow matches /"), F.col("host")),
        Rule("Important", "Robots.txt", "robots.txt has no Sitemap: line", there & (F.coalesce(F.size("declared"), F.lit(0)) < 1), F.lit("(none)"), F.col("host")),
        Rule("Important", "Robots.txt", "robots.txt has no User-agent group", there & ~F.rlike("body", F.lit(r"(?im)^\s*user-agent:")), None, F.col("host")),
    ])
    named = rows.where(there).select("host", "url", F.explode("declared").alias("loc"))
    loads = files.groupBy(F.col("url").alias("loc")).agg(F.bool_or(F.col("status") == 200).alias("loads"))
    elsewhere = (U.host(F.col("loc")) != "") & (U.host(F.col("loc")) != F.lower("host"))
    declared = evaluate(named.join(loads, "loc", "left"), [
        Rule("Important", "Robots.txt", "robots.txt sitemap on a different host", elsewhere, F.col("loc"), F.col("host")),
        Rule("Critical", "Robots.txt", "Sitemap declared in robots.txt is unreachable", ~elsewhere & ~F.coalesce("loads", F.lit(False)), F.col("loc"), F.col("host")),
    ])
    return _together(own, declared)


def _marks(records: DataFrame) -> DataFrame:
    marks = {c: F.coalesce(c, F.lit(False)) for c in ("in_sitemap", "robots_blocked", "is_html", "noindex")}
    return records.withColumns({**marks, "canonical": _text(F.col("canonical"))}).withColumn("at", F.when(F.col("canonical") != "", U.resolve(F.col("url"), F.col("canonical"))))


def listed_url_rules(records: DataFrame) -> DataFrame:
    """Issues of the records of a sitemap's urls, and of the site where canonical urls have another host.

    records: url, status, error, redirect_to, in_sitemap, robots_blocked, is_html, noindex, canonical.
    """
    rows = _marks(records).where("in_sitemap AND status IS NOT NULL")
    status, read = F.col("status"), F.col("status") == 200
    other = F.col("at").isNotNull() & (U.norm(F.col("at")) != U.norm(F.col("url")))
    same_path = U.path_key(F.col("at")) == U.path_key(F.col("url"))
    answer = F.concat(F.lit("HTTP "), status.cast("string"))
    own = evaluate(rows, [
        Rule("Important", "Sitemap URL", "Sitemap URL redirects", status.isin(*REDIRECTS), F.concat(answer, F.lit(" -> "), U.resolve(F.col("url"), _text(F.col("redirect_to"))))),
        Rule("Critical", "Sitemap URL", "Sitemap URL is not 200", ~read & ~status.isin(*REDIRECTS), F.trim(F.concat(answer, F.lit(" "), _text(F.col("error"))))),
        Rule("Critical", "Sitemap URL", "Sitemap URL blocked by robots.txt", F.col("robots_blocked"), F.lit("Disallowed for Googlebot")),
        Rule("Critical", "Sitemap URL", "Sitemap URL is noindex", read & F.col("noindex"), F.lit("noindex")),
        Rule("Important", "Sitemap URL", "Sitemap URL canonicalises elsewhere", read & other & ~same_path, F.col("canonical")),
    ])
    hosts = rows.where(read & other & same_path).select(U.host(F.col("at")).alias("c"), U.host(F.col("url")).alias("s")).where("c <> '' AND s <> '' AND c <> s").distinct()
    site = evaluate(hosts.withColumn("url", F.lit(SITE_WIDE)), [Rule("Important", "Sitemap", "Sitemap host differs from the canonical host", F.lit(True), F.concat(F.lit("canonical host "), "c", F.lit(", sitemap host "), "s"))])
    return _together(own, site)


def coverage_rules(records: DataFrame) -> DataFrame:
    """Issues of crawled urls: the first rule that fits a record, of blocked, redirecting, broken, missing from the sitemap
    and not a page.

    records: those of `listed_url_rules` with content_type, via, found_on and sources.
    """
    found = F.coalesce(F.nullif(_text(F.col("found_on")), F.lit("")), F.when(F.col("in_sitemap"), "sitemap.xml"), F.lit(""))
    status, unlisted = F.col("status"), ~F.col("in_sitemap")
    redirects = status.isin(*REDIRECTS)
    itself = (F.col("canonical") == "") | (U.norm(F.col("at")) == U.norm(F.col("url")))
    branch = (
        F.when(F.col("robots_blocked"), F.when(_text(F.col("found_on")) != "", "blocked"))
        .when(redirects & unlisted, "redirect").when((status != 200) & ~redirects & unlisted, "broken")
        .when(F.col("is_html") & (status == 200) & unlisted & ~F.col("noindex"), F.when(itself, "missing"))
        .when((status == 200) & (_text(F.col("content_type")) != "") & ~F.col("is_html") & (F.col("via") == "link"), "other")
    )
    rows = _marks(records).withColumns({"from": F.concat(F.lit("linked from "), found), "branch": branch})
    answer, is_ = F.concat(F.lit("HTTP "), status.cast("string")), lambda b: F.col("branch") == b
    gone = F.trim(F.concat(answer, F.lit(" "), _text(F.col("error"))))
    grave = (status >= 500) | (status == 0)
    return evaluate(rows, [
        Rule("Optimization", "Crawl", "Internal URL blocked by robots.txt", is_("blocked"), F.lit("Disallowed"), F.col("from")),
        Rule("Optimization", "Crawl", "Internal URL redirects", is_("redirect"), F.concat(answer, F.lit(" -> "), _text(F.col("redirect_to"))), F.col("from")),
        Rule("Critical", "Crawl", "Broken internal URL", is_("broken") & grave, gone, F.col("from")),
        Rule("Important", "Crawl", "Broken internal URL", is_("broken") & ~grave, gone, F.col("from")),
        Rule("Important", "Coverage", "Live page missing from sitemap", is_("missing"), F.lit("not in sitemap.xml"), F.col("from")),
        Rule("Optimization", "Crawl", "Internal link to a non-HTML page", is_("other"), F.col("content_type"), F.col("from")),
    ]).select(*COLUMNS)
