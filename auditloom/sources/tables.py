"""Typed readers. Facts that other systems collect (responses, browser metrics, validator messages) come in as
tables with declared schemas; nothing here drives a browser or the network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.operators.sized import sized_join

SCHEMAS = {
    "responses": "status int, url string, headers map<string,string>, content binary, ms int, history array<struct<code:int,url:string,location:string>>, location string, error string, http_version string",
    "crawl_records": "url string, status int, content_type string, is_html boolean, ms int, via string, found_on string, in_sitemap boolean, robots_blocked boolean, redirect_to string, title string, canonical string, noindex boolean, error string, depth int, inlinks long, js_only boolean, sources array<string>, final_url string, redirect_hops int",
    "issues": "url string, severity string, priority string, category string, issue string, description string, current_value string, expected_value string, recommended_fix string, element string, details string, http_status string, in_sitemap string, report string, id string",
    "browser_metrics": "url string, ttfb double, fcp double, lcp double, cls double, tbt double, inp double, resources array<struct<url:string,type:string,size:long,body:long,decoded:long,duration:double,protocol:string,blocking:boolean>>",
    "images": "src string, status int, bytes long, format string, natural struct<w:int,h:int>",
    "certificates": "host string, issuer string, not_before timestamp, not_after timestamp, days int, tls string",
    "validator_messages": "url string, type string, subType string, message string, extract string, firstLine int, lastLine int",
    "network_requests": "page string, url string, host string, resource_type string, status int, failure string, ms int, bytes long",
    "human_results": "id string, status string, note string, by string, date string, server string",
}


def facts(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A JSON fact table under its declared schema; a malformed row is kept with nulls, as the reader is permissive."""
    return spark.read.schema(SCHEMAS[name]).json(path)


def pages_as_responses(pages: DataFrame) -> DataFrame:
    """Stored pages as fetched: status 200, no headers."""
    return pages.select(F.lit(200).alias("status"), "url", F.create_map().cast("map<string,string>").alias("headers"), F.encode("html", "utf-8").alias("content"))


def _blocks(column: str, name: str) -> Column:
    """The elements of a name in XML text, whatever prefix their namespace has."""
    return F.regexp_extract_all(column, F.lit(rf"(?is)<(?:\w+:)?{name}>.*?</(?:\w+:)?{name}>"), F.lit(0))


def _inner(column: str, name: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(column, rf"(?is)<(?:\w+:)?{name}>\s*(.*?)\s*</(?:\w+:)?{name}>", 1)), F.lit(""))


def sitemap_entries(xml: DataFrame, column: str = "xml") -> DataFrame:
    """(loc, lastmod) of every <url> of the sitemaps in a text column, duplicates kept."""
    rows = xml.select(F.explode(_blocks(column, "url")).alias("b"))
    return rows.select(_inner("b", "loc").alias("loc"), _inner("b", "lastmod").alias("lastmod"))


def sitemap_children(files: DataFrame) -> DataFrame:
    """(url, loc, status, entries, problem) of the sitemaps that an index among the fetched files (url, status, body) names.

    A child that was not fetched has status 0. Its entries come with `sitemap_entries` of the same files.
    """
    named = files.select("url", F.explode(_blocks("body", "sitemap")).alias("b")).select("url", _inner("b", "loc").alias("loc")).where("loc IS NOT NULL")
    known = files.groupBy(F.col("url").alias("loc")).agg(F.max(F.struct("status", F.size(_blocks("body", "url")).alias("entries"))).alias("f"))
    rows = named.join(known, "loc", "left").select("url", "loc", F.coalesce("f.status", F.lit(0)).alias("status"), F.greatest(F.coalesce("f.entries", F.lit(0)), F.lit(0)).alias("entries"))
    problem = F.when(F.col("status") != 200, F.concat(F.lit("HTTP "), "status")).when(F.col("entries") == 0, "no <url> entries").otherwise("")
    return rows.withColumn("problem", problem)


def without_namespace(files: DataFrame) -> DataFrame:
    """(url) of fetched sitemaps whose root does not name the namespace of sitemaps."""
    root = F.regexp_extract("body", r"(?is)<(?:\w+:)?(?:urlset|sitemapindex)\b[^>]*>", 0)
    return files.where((root != "") & ~F.contains(root, F.lit("http://www.sitemaps.org/schemas/sitemap/0.9"))).select("url")


def robots_rules(robots: DataFrame) -> DataFrame:
    """(host, group, agents, kind, path, at) of the allow, disallow and sitemap lines of (host, body), in the order of `at`.

    User-agent lines that follow each other head one group, and the rules after them are for all of these agents. A
    blank line ends a group; rules outside a group count for nobody. Sitemaps belong to no agent. Comments are cut.
    """
    lines = robots.select("host", F.posexplode(F.split("body", "\r?\n")).alias("at", "line")).withColumn("line", F.trim(F.regexp_replace("line", "#.*", "")))
    kind, value = F.lower(F.regexp_extract("line", r"^([A-Za-z-]+)\s*:", 1)), F.trim(F.regexp_extract("line", r"^[A-Za-z-]+\s*:\s*(.*)$", 1))
    lines = lines.select("host", "at", kind.alias("kind"), value.alias("path"), (F.col("line") == "").alias("blank"))
    agent, rule = F.col("kind") == "user-agent", F.col("kind").isin("allow", "disallow", "crawl-delay", "request-rate")
    order = Window.partitionBy("host").orderBy("at")
    events = lines.where(agent | rule | F.col("blank"))
    head = agent & ~F.coalesce(F.lag(agent).over(order), F.lit(False))
    events = events.withColumn("group", F.sum(F.when(head | F.col("blank"), 1).otherwise(0)).over(order))
    agents = events.where(agent).groupBy("host", "group").agg(F.collect_set(F.lower("path")).alias("agents"))
    rules = events.where(F.col("kind").isin("allow", "disallow")).join(agents, ["host", "group"]).select("host", "group", "agents", "kind", "path", "at")
    sitemaps = lines.where("kind = 'sitemap' AND path <> ''").select("host", F.lit(None).cast("long").alias("group"), F.lit(None).cast("array<string>").alias("agents"), "kind", "path", "at")
    return rules.unionByName(sitemaps)


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str = "*") -> DataFrame:
    """(host, path, allowed): the first rule of the agent's group whose path starts the url's decides.

    A named agent follows the first group that names it (a part of its name is enough), else the first one for `*`.
    An empty disallow allows everything. Without a fitting rule a url is allowed.
    A host's rules travel as one array (a robots file is read up to a fixed size, so it is short), and urls meet them
    by host without a hot key.
    """
    name = agent.split("/")[0].lower()
    own = rules.where(F.col("kind").isin("allow", "disallow")).withColumn("own", F.exists("agents", lambda a: (a != "*") & F.contains(F.lit(name), a))).withColumn("any", F.array_contains("agents", "*"))
    first = own.groupBy("host").agg(F.coalesce(F.min(F.when(F.col("own"), F.col("group"))), F.min(F.when(F.col("any"), F.col("group")))).alias("group"))
    allow = (F.col("kind") == "allow") | (F.col("path") == "")
    group = own.join(first, ["host", "group"]).select(F.col("host").alias("r_host"), "at", allow.alias("allow"), F.regexp_replace("path", r"^\*$", "").alias("prefix"))
    ordered = group.groupBy(F.col("r_host").alias("host")).agg(F.sort_array(F.collect_list(F.struct("at", "allow", "prefix"))).alias("rules"))
    met = sized_join(urls.select("host", "path").distinct(), ordered, "host", "left")
    first = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["prefix"])), 0)
    return met.select("host", "path", F.coalesce(first["allow"], F.lit(True)).alias("allowed"))


def latest_reports(reports: DataFrame) -> DataFrame:
    """The newest report of each key, by date and time."""
    others = [c for c in reports.columns if c not in ("key", "date", "time")]
    top = reports.groupBy("key").agg(F.max(F.struct("date", "time", *others)).alias("m"))
    return top.select("key", "m.*")
