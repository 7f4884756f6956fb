"""What pages load, and facts of a run. Events stand in for loaded resources, labels and pages for scores and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions import classify as C
from auditloom.functions import html as H
from auditloom.operators import resources as R
from auditloom.operators import run_facts as N
from auditloom.sources import tables as S

from .content import lit
from .joins import RECORDS_SQL, crawl_records
from .links import LINKS_SQL
from .registry import query, table
from .rollup import BOTH_SQL, every_issue
from .scalars import values

ADDRESSES = ["https://a.cdn.com/x.js?v=1", "https://a.cdn.com/main.css", "http://img.net/p.PNG", "https://fonts.org/f.woff2", "https://api.io/data", "https://s.org/_next/image?url=a", "https://b.cdn.com/app.js"]
TYPES = ["script", "link", "img", "fetch"]
USES = ["Script", "Stylesheet", "Image", "Link", "Iframe"]
PROBES = [
    ("https://a.cdn.com/x.js?v=1", "Error", 500, None, 0, None), ("https://a.cdn.com/main.css", "OK", 200, None, 0, None), ("http://img.net/p.PNG", "Redirect", 200, "https://img.net/p.PNG", 2, None),
    ("https://fonts.org/f.woff2", "Timeout", 0, None, 0, "no answer"), ("https://b.cdn.com/app.js", "SSL Error", 0, None, 0, ""),
]
PROBE = "url string, status string, code int, final string, hops int, error string"


def one_of(names: list[str], n) -> F.Column:
    return F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))


def sql_one_of(names: list[str], n: str) -> str:
    return "[" + ", ".join(map(lit, names)) + f"][{n} % {len(names)} + 1]"


USED_SQL = f"""used AS (SELECT 'https://s.org/' || user_id AS page, {sql_one_of(ADDRESSES, "event_id")} AS url, {sql_one_of(TYPES, "event_id")} AS type, {sql_one_of(USES, "event_id")} AS kind,
  CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 1000 END AS size, event_id % 500 AS body FROM events)"""
PROBED_SQL = "p AS " + values(PROBES, "url, status, code, final, hops, error") + ", met AS (SELECT used.page, used.url, kind, status, code, hops, error, lower(regexp_extract(used.url, '//([^/?#]*)', 1)) AS host FROM used JOIN p USING (url))"


def used(spark, sf_dir):
    """Resources laid over the events: users are pages, ids say what was loaded and how large it was."""
    n = F.col("event_id")
    size = F.when(n % 3 == 0, 0).otherwise(n % 1000)
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("https://s.org/"), "user_id").alias("page"), one_of(ADDRESSES, n).alias("url"), one_of(TYPES, n).alias("type"), one_of(USES, n).alias("kind"), size.alias("size"), (n % 500).alias("body")
    )


@query("WITH " + USED_SQL + r""", k AS (SELECT page, CASE WHEN type = 'script' OR path LIKE '%.js' THEN 'js' WHEN type = 'css' OR path LIKE '%.css' OR (type = 'link' AND path LIKE '%.css%') THEN 'css'
WHEN type = 'img' OR path LIKE '%/_next/image%' OR regexp_matches(path, '\.(png|jpg|jpeg|webp|avif|gif|svg)$') THEN 'img' WHEN regexp_matches(path, '\.(woff|woff2|ttf|otf)$') THEN 'font' ELSE 'other' END AS kind,
coalesce(nullif(size, 0), body, 0) AS bytes FROM (SELECT *, lower(string_split(url, '?')[1]) AS path FROM used))
SELECT page, """ + ", ".join(f"coalesce(sum(bytes) FILTER (kind = '{k}'), 0)::BIGINT AS {k}" for k in R.KINDS) + ", sum(bytes)::BIGINT AS total FROM k GROUP BY 1")
def bytes_by_kind(spark, sf_dir):
    return R.bytes_by_kind(used(spark, sf_dir))


@query("WITH " + USED_SQL + ", " + PROBED_SQL + """, c AS (SELECT host, count(*)::BIGINT AS uses, count(DISTINCT page)::BIGINT AS pages, count(*) FILTER (status IN ('Error', 'Timeout', 'SSL Error'))::BIGINT AS failing FROM met GROUP BY 1)
SELECT c.*, array_to_string((SELECT list(DISTINCT page ORDER BY page) FROM met WHERE met.host = c.host)[1:20], ' ') AS first_pages, array_to_string((SELECT list(DISTINCT url ORDER BY url) FROM met WHERE met.host = c.host)[1:20], ' ') AS first_urls FROM c""")
def third_party_domains(spark, sf_dir):
    """Hosts of what is loaded, with the first 20 pages and addresses of each."""
    rows = R.third_party_domains(used(spark, sf_dir), spark.createDataFrame(PROBES, PROBE))
    return rows.withColumns({c: F.array_join(c, " ") for c in ("first_pages", "first_urls")})


@query("WITH " + USED_SQL + ", " + PROBED_SQL + """, i AS (
SELECT page AS url, CASE WHEN status <> 'Timeout' AND kind IN ('Script', 'Stylesheet', 'Iframe') THEN 'Critical' ELSE 'Important' END AS severity, 'Third-party URL ' || CASE status WHEN 'Error' THEN 'broken' WHEN 'Timeout' THEN 'timeout' ELSE 'SSL error' END AS issue,
  CASE WHEN code > 0 THEN 'HTTP ' || code ELSE coalesce(nullif(error, ''), status) END AS current_value, met.url AS element FROM met WHERE status IN ('Error', 'Timeout', 'SSL Error')
UNION ALL SELECT page, 'Optimization', 'Third-party URL redirects', hops || ' redirect(s)', met.url FROM met WHERE status = 'Redirect'
UNION ALL SELECT page, CASE WHEN kind = 'Link' THEN 'Optimization' ELSE 'Important' END, 'Third-party URL over http:// (insecure)', met.url, met.url FROM met WHERE met.url LIKE 'http://%' AND page LIKE 'https://%')
SELECT * FROM i""")
def report_third_parties(spark, sf_dir):
    """Report 19: third parties that fail, redirect or are not encrypted, for every page that uses them."""
    return R.third_party_rules(used(spark, sf_dir), spark.createDataFrame(PROBES, PROBE)).select("url", "severity", "issue", "current_value", "element")


@query("WITH " + RECORDS_SQL + """, a AS (SELECT CASE WHEN status = 0 THEN '?' ELSE status::VARCHAR END AS answer, count(*)::BIGINT AS n FROM records GROUP BY 1) SELECT answer, n FROM a ORDER BY n DESC, answer LIMIT 5""")
def crawl_answers(spark, sf_dir):
    """The five most frequent answers of a crawl; the report is of this length."""
    return N.answers(crawl_records(spark, sf_dir).withColumn("error", F.lit(None).cast("string")))


@query("WITH " + RECORDS_SQL + " SELECT url, in_sitemap FROM records WHERE is_html AND status = 200 AND (in_sitemap OR ms % 2 = 0)")
def site_pages(spark, sf_dir):
    """Pages of the sitemap, then those found; every second page is laid out as naming another one as its own."""
    canonical = F.when(F.col("ms") % 2 == 0, F.concat("url", F.lit(""))).otherwise("https://elsewhere.org/")
    return N.site_pages(crawl_records(spark, sf_dir).withColumns({"canonical": canonical, "ord": F.col("page_id")})).select("url", "in_sitemap")


@query(LINKS_SQL + r""", e AS (SELECT regexp_extract(url, '//([^?#]*)', 1) AS source, regexp_extract(url, '//([^/?#]*)', 1) || href AS target, nth FROM links WHERE href LIKE '/_%' AND href NOT LIKE '//%')
SELECT DISTINCT target AS url FROM e WHERE nth % 3 = 0 AND target NOT IN (SELECT target FROM e WHERE nth % 3 <> 0 AND source <> target)""")
def script_only(spark, sf_dir):
    """Targets that only scripts lead to; every third link of a page is laid out as one that a script makes."""
    rows = table(spark, sf_dir, "pages").select("url", F.posexplode(H.anchors(F.col("html"))).alias("at", "a")).where(F.col("a.href").rlike("^/.") & ~F.col("a.href").startswith("//"))
    rows = rows.select(F.regexp_extract("url", "//([^?#]*)", 1).alias("source"), F.concat(F.regexp_extract("url", "//([^/?#]*)", 1), "a.href").alias("target"), ((F.col("at") + 1) % 3 == 0).alias("script"))
    return N.script_only(rows.where("NOT script"), rows.where("script"))


@query(BOTH_SQL + """ SELECT count(*)::BIGINT AS pages, count(*) FILTER (url NOT IN (SELECT url FROM every WHERE severity IN ('Critical', 'Important') AND url IS NOT NULL))::BIGINT AS clean FROM pages""")
def clean_pages(spark, sf_dir):
    return N.clean_pages(table(spark, sf_dir, "pages"), every_issue(spark, sf_dir))


SHARED = ["/share.png", "/share.png", "/share.png", "/other.png"]


@query(f"""WITH s AS (SELECT {sql_one_of(SHARED, "page_id")} AS og_image FROM pages), c AS (SELECT og_image, count(*) AS n FROM s GROUP BY 1), t AS (SELECT sum(n) AS total, max(n) AS n, max_by(og_image, n) AS og_image FROM c)
SELECT '(site-wide)' AS url, 'Same share image on most pages' AS issue, n || ' of ' || total || ' pages' AS current_value, og_image AS element FROM t WHERE total > 5 AND n > 0.5 * total""")
def dominant_image(spark, sf_dir):
    """One share image on most pages; images are laid over the pages."""
    rows = table(spark, sf_dir, "pages").select(one_of(SHARED, F.col("page_id")).alias("og_image"))
    return N.dominant_image(rows).select("url", "issue", "current_value", "element")


@query("""WITH r AS (SELECT CASE WHEN value <= 20 THEN 'Good' ELSE 'Poor' END AS lcp, CASE WHEN event_id % 4 > 0 THEN 'Good' ELSE 'Poor' END AS cls, ['Good', 'n/a', 'Poor'][event_id % 3 + 1] AS inp FROM events)
SELECT count(*)::BIGINT AS pages, count(*) FILTER (lcp = 'Good' AND cls = 'Good' AND inp <> 'Poor')::BIGINT AS passing FROM r""")
def vitals_passing(spark, sf_dir):
    """Measurements that pass all three core vitals; ratings are laid over the events."""
    n = F.col("event_id")
    ratings = table(spark, sf_dir, "events").select(F.when(F.col("value") <= 20, "Good").otherwise("Poor").alias("lcp"), F.when(n % 4 > 0, "Good").otherwise("Poor").alias("cls"), one_of(["Good", "n/a", "Poor"], n).alias("inp"))
    return N.passing(ratings)


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN printf('%.3f', round(value, 1)) WHEN event_id % 500 >= 100 THEN printf('%.2f s', (event_id % 500) / 100) ELSE (event_id % 500) * 10 || ' ms' END AS shown FROM events""")
def vitals_shown(spark, sf_dir):
    """Measurements as a report shows them: clicks as shifts, ids of other events as tens of milliseconds."""
    shift = F.col("event_type") == "click"
    value = F.when(shift, F.round("value", 1)).otherwise((F.col("event_id") % 500 * 10).cast("double"))
    return table(spark, sf_dir, "events").select("event_id", C.vitals_shown(F.when(shift, "cls").otherwise("lcp"), value).alias("shown"))


@query("""WITH s AS (SELECT category, avg(v) AS v FROM (SELECT 'quality' AS category, quality * 100.0 AS v FROM labels UNION ALL SELECT 'toxic', toxic * 100.0 FROM labels) WHERE v IS NOT NULL GROUP BY 1), e AS (SELECT category, round(v, 1)::DOUBLE AS average FROM s)
SELECT * FROM e UNION ALL SELECT 'Overall', round(avg(average), 1)::DOUBLE FROM e""")
def category_averages(spark, sf_dir):
    """Average score of each category and of all; the labels stand in for scores of 0 or 100."""
    scores = table(spark, sf_dir, "labels").select((F.col("quality") * 100).alias("quality"), (F.col("toxic") * 100).alias("toxic"))
    return N.category_averages(scores, ("quality", "toxic"))


@query("""WITH i AS (SELECT event_id, list_transform([11, 3, 11, 7, 5, 13, 17], lambda m: 'k' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % m)) AS labels FROM events)
SELECT event_id, array_to_string(list_filter(labels, lambda x, nth: list_position(labels, x) = nth)[1:5], ' ') AS labels, 7 AS total FROM i""")
def failing_items(spark, sf_dir):
    """The first five items of an audit's details; seven are laid out for each event."""
    k = F.get_json_object("props", "$.k").cast("long")
    items = F.array(*[F.struct(F.concat(F.lit("k"), k % m).alias("label")) for m in (11, 3, 11, 7, 5, 13, 17)])
    rows = table(spark, sf_dir, "events").select("event_id", N.failing_items(F.to_json(F.struct(items.alias("items")))).alias("f"))
    return rows.select("event_id", F.array_join("f.labels", " ").alias("labels"), "f.total")


@query("""WITH f AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1) SELECT source AS key, source || ': ' || n || ' of 2500 pages' AS note FROM f WHERE n < 0.9 * 2500""")
def partial_coverage(spark, sf_dir):
    """Reports that saw too few pages; sources stand in for reports and their documents for the pages that were checked."""
    rows = table(spark, sf_dir, "documents").where("source IS NOT NULL").groupBy(F.col("source").alias("key")).agg(F.count("*").alias("pages_checked"))
    return N.partial_coverage(rows, 2500)


@query("""WITH s AS (SELECT coalesce(source, '') AS server, count(*) AS n FROM documents GROUP BY 1) SELECT max_by(server, (n, server)) AS server, count(*)::BIGINT AS servers, count(*) > 1 AS mixed FROM s HAVING count(*) > 0""")
def servers(spark, sf_dir):
    """The server of most reports, and whether there are several; sources stand in for servers."""
    return N.servers(table(spark, sf_dir, "documents").select(F.col("source").alias("server")))


@query(r"""WITH p AS (SELECT regexp_extract(url, '//(?:www\.)?([^/?#]*)', 1) AS name, page_id FROM pages) SELECT 'host' AS source, name, count(DISTINCT page_id)::BIGINT AS pages FROM p
WHERE trim(lower(name)) <> '' AND NOT contains(lower(name), 'example.com') AND NOT contains('example.com', lower(name)) GROUP BY 2""")
def name_variants(spark, sf_dir):
    """Names that are written differently; hosts stand in for names of the firm."""
    names = table(spark, sf_dir, "pages").select(F.lit("host").alias("source"), F.regexp_extract("url", r"//(?:www\.)?([^/?#]*)", 1).alias("name"), F.col("page_id").alias("page"))
    return N.name_variants(names, "example.com")


FILES = ["src/a{n}.py", "web/.next/b{n}.js", "a/__pycache__/c{n}.pyc", "dist/d{n}.js", "coverage/e{n}.txt", "x/node_modules/f{n}"]


@query("WITH f AS (SELECT replace(" + sql_one_of(FILES, "p_partkey") + ", '{n}', p_partkey::VARCHAR) AS path FROM part), b AS (SELECT path, CASE " + " ".join(f"WHEN contains(path, '{m}') THEN '{m}'" for m in ("__pycache__", ".next", "node_modules", ".DS_Store", ".tsbuildinfo", ".pyc", "dist", "out")) + rf""" ELSE 'build output' END AS kind FROM f WHERE regexp_matches(path, {lit(C.ARTEFACTS)}))
SELECT kind, count(*)::BIGINT AS files, array_to_string(list(path ORDER BY path)[1:5], ', ') AS examples FROM b GROUP BY 1""")
def file_groups(spark, sf_dir):
    """Built files of a repository by kind; paths are laid over the parts."""
    n = F.col("p_partkey")
    return R.file_groups(table(spark, sf_dir, "part").select(F.replace(one_of(FILES, n), F.lit("{n}"), n.cast("string")).alias("path")))


@query("""WITH c AS (SELECT page_id, page_id + k AS n FROM pages, (SELECT unnest([0, 1]) AS k)), f AS (SELECT page_id AS n, CASE WHEN page_id % 5 = 0 THEN 404 ELSE 200 END AS status, (page_id % 3)::INTEGER AS entries FROM pages)
SELECT 'i' || page_id AS url, 's' || c.n AS loc, coalesce(status, 0)::INTEGER AS status, coalesce(entries, 0)::INTEGER AS entries, CASE WHEN coalesce(status, 0) <> 200 THEN 'HTTP ' || coalesce(status, 0) WHEN entries = 0 THEN 'no <url> entries' ELSE '' END AS problem FROM c LEFT JOIN f USING (n)""")
def sitemap_children(spark, sf_dir):
    """The sitemaps that indexes name: for each page an index of two and a sitemap of up to two entries are laid out."""
    n = F.col("page_id")
    child = lambda k: F.concat(F.lit("<sitemap><loc>s"), n + k, F.lit("</loc></sitemap>"))
    entry = F.concat(F.lit("<url><loc>"), n, F.lit("</loc></url>"))
    pages = table(spark, sf_dir, "pages")
    indexes = pages.select(F.concat(F.lit("i"), n).alias("url"), F.lit(200).alias("status"), F.concat(child(0), child(1)).alias("body"))
    return S.sitemap_children(indexes.unionByName(pages.select(F.concat(F.lit("s"), n).alias("url"), F.when(n % 5 == 0, 404).otherwise(200).alias("status"), F.repeat(entry, (n % 3).cast("int")).alias("body"))))
