"""Classifications and small joins: statuses, dates, headers, languages, names, compounds, suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions import classify as C
from auditloom.functions import urls as U

from auditloom.operators.element_rules import alternate_problems, heading_outline
from auditloom.operators.graph import cut_lineage

from .content import KNOWN, PHONE, documents, lit
from .onpage import URL_SQL
from .registry import query, table


def values(rows: list[tuple], names: str) -> str:
    """The same literal rows for DuckDB."""
    cell = lambda v: "NULL" if v is None else str(v) if not isinstance(v, str) else lit(v)
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") AS t({names}))"


@query("WITH " + URL_SQL + rf"""SELECT url, NOT regexp_matches(lower(raw_path), {lit(C.SKIP_PATH)}) AND NOT regexp_matches(lower(raw_path), {lit(C.SKIP_EXT)}) AS crawlable,
  NOT regexp_matches(host, {lit(C.PRIVATE_HOST)}) AS public, CASE WHEN len(string_split(host, '.')) >= 2 THEN string_split(host, '.')[-2] ELSE host END AS domain,
  regexp_matches(path, {lit(C.TEST_PAGE)}) AS test_page FROM urls""")
def url_classes(spark, sf_dir):
    u = F.col("url")
    h, p = U.host(u), U.raw_path(u)
    return table(spark, sf_dir, "pages").select("url", C.crawlable(h, p, h).alias("crawlable"), C.is_public(h).alias("public"), C.registered_domain(h).alias("domain"), U.path(u).rlike(C.TEST_PAGE).alias("test_page"))


@query(rf"""SELECT doc_id, 'debug' AS kind, unnest(regexp_extract_all(lower(text), {lit(C.DEBUG_TEXT)})) AS hit FROM documents
UNION ALL SELECT doc_id, 'url', unnest(regexp_extract_all(text, 'https?://[A-Za-z0-9./_-]+')) FROM documents
UNION ALL SELECT doc_id, 'development url', unnest(regexp_extract_all(text, {lit(C.DEV_URL)})) FROM documents""")
def leftovers(spark, sf_dir):
    """Debug output, urls and development urls in texts, in one pass."""
    def marked(kind):
        return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("hit"))

    found = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), marked(k)) for k, text, p in (("debug", F.lower("text"), C.DEBUG_TEXT), ("url", F.col("text"), "https?://[A-Za-z0-9./_-]+"), ("development url", F.col("text"), C.DEV_URL))]
    return documents(spark, sf_dir).select("doc_id", F.explode(F.flatten(F.array(*found))).alias("f")).select("doc_id", "f.kind", "f.hit")


STATUSES = [200, 301, 404, 0, 403, 500, 999, 429]


@query(f"""WITH s AS (SELECT o_orderkey, {STATUSES}[o_orderkey % 8 + 1] AS status, o_orderkey % 3 AS hops, o_orderkey % 13 = 0 AS is_loop FROM orders)
SELECT o_orderkey, CASE WHEN status IN (401, 403, 429, 999) THEN 'Info' WHEN status = 0 OR status >= 400 THEN 'Important' END AS severity,
  CASE WHEN status IN (401, 403, 429, 999) THEN 'unverified' WHEN status = 0 OR status >= 400 THEN 'broken' WHEN status >= 300 THEN 'redirect' ELSE 'ok' END AS external_result,
  CASE WHEN is_loop THEN 'loop' WHEN status = 0 OR status >= 400 THEN 'broken' WHEN hops > 1 THEN 'chain' WHEN hops = 1 THEN 'redirect' ELSE 'OK' END AS internal_result FROM s""")
def status_ladders(spark, sf_dir):
    """Link results by status, with statuses laid over order keys."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k, F.element_at(F.array(*map(F.lit, STATUSES)), (k % 8 + 1).cast("int")).alias("status"))
    severity, result = C.external_status(F.col("status"))
    return rows.select(k, severity.alias("severity"), result.alias("external_result"), C.internal_result(k % 13 == 0, F.col("status"), k % 3).alias("internal_result"))


DATES = [("2026",), ("2026-02",), ("2026-02-03",), ("2026-02-03T04:05:06",), ("2026-02-03T04:05:06+02:00",), ("2026-02-03T04:05:06Z",), ("soon",), ("2026-13",), (None,)]


@query("""WITH v AS """ + values(DATES, "value") + r""", p AS (SELECT value, CASE
  WHEN regexp_full_match(value, '\d{4}') THEN value || '-01-01 00:00:00+00' WHEN regexp_full_match(value, '\d{4}-\d{2}') THEN value || '-01 00:00:00+00'
  WHEN regexp_full_match(value, '\d{4}-\d{2}-\d{2}') THEN value || ' 00:00:00+00' WHEN regexp_full_match(value, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}') THEN value || '+00' ELSE value END AS full_value FROM v)
SELECT value, epoch_us(try_cast(full_value AS TIMESTAMPTZ)) // 1000000 AS seconds FROM p""")
def w3c_dates(spark, sf_dir):
    return spark.createDataFrame(DATES, "value string").select("value", F.unix_seconds(C.w3c_date(F.col("value"))).alias("seconds"))


HEADS = [("FFD8FFE0",), ("89504E470D0A1A0A",), ("4749463839",), ("52494646AAAAAAAA57454250",), ("0000001C6674797061766966",), ("00000100",), ("3C737667",)]


@query("WITH v AS " + values(HEADS, "head") + r"""SELECT head, CASE WHEN head LIKE '52494646%' AND substr(head, 17, 8) = '57454250' THEN 'webp' WHEN substr(head, 9, 16) IN ('6674797061766966', '6674797061766973') THEN 'avif'
WHEN head LIKE 'FFD8FF%' THEN 'jpeg' WHEN head LIKE '89504E47%' THEN 'png' WHEN head LIKE '47494638%' THEN 'gif' WHEN head LIKE '00000100%' THEN 'ico' WHEN head LIKE '424D%' THEN 'bmp' ELSE 'unknown' END AS format FROM v""")
def image_formats(spark, sf_dir):
    return spark.createDataFrame(HEADS, "head string").select("head", C.image_format(F.col("head")).alias("format"))


HREFLANG = [("/a", "en", "/a"), ("/a", "de", "/b"), ("/b", "de", "/b"), ("/b", "en", "/a"), ("/c", "fr", "/a"), ("/c", "uk-UA", "/d"), ("/d", "en-UK", "/c"), ("/d", "xx1", "/d"), ("/d", "x-default", "/a")]


@query("WITH v AS " + values(HREFLANG, "page, code, href") + r"""SELECT page, code, href, NOT regexp_matches(lower(code), '^([a-z]{2,3}(-[a-z]{4})?(-([a-z]{2}|[0-9]{3}))?|x-default)$') OR regexp_matches(lower(code), '-(uk|en|eu)$') AS invalid,
  page <> href AND NOT EXISTS (SELECT 1 FROM v b WHERE b.page = v.href AND b.href = v.page) AS no_return FROM v""")
def hreflang_rules(spark, sf_dir):
    """Language codes that are invalid, and alternates that do not link back: a semi-join on the reversed pair."""
    return alternate_problems(spark.createDataFrame(HREFLANG, "page string, code string, href string"))


HEADINGS = [("p", 1, 1, "A"), ("p", 2, 3, "B"), ("p", 3, 2, "C"), ("q", 1, 2, "D"), ("q", 2, 4, "E"), ("q", 3, 5, "F")]


@query("WITH v AS " + values(HEADINGS, "url, ord, level, text") + """, w AS (SELECT *, lag(level) OVER (PARTITION BY url ORDER BY ord) AS prev_level FROM v)
SELECT url, ord, prev_level, level, repeat('    ', level - 1) || text AS outline, prev_level IS NOT NULL AND level > prev_level + 1 AS skipped FROM w""")
def heading_skips(spark, sf_dir):
    return heading_outline(spark.createDataFrame(HEADINGS, "url string, ord int, level int, text string"))


@query(rf"""WITH v AS (SELECT doc_id, unnest(regexp_extract_all(text, {lit(PHONE)})) AS shown FROM documents), k AS (SELECT *, right(regexp_replace(shown, '[^0-9]', '', 'g'), 10) AS key FROM v),
c AS (SELECT key, shown, count(*) AS n FROM k GROUP BY 1, 2), m AS (SELECT key, min_by(shown, (-n, shown)) AS shown FROM c GROUP BY 1)
SELECT m.key, m.shown, count(DISTINCT doc_id)::BIGINT AS docs, count(*)::BIGINT AS times FROM m JOIN k ON m.key = k.key GROUP BY 1, 2""")
def phone_rollup(spark, sf_dir):
    """Each number with its most frequent spelling, documents and occurrences."""
    shown = documents(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(PHONE), F.lit(0))).alias("shown"))
    keyed = shown.withColumn("key", F.right(F.regexp_replace("shown", "[^0-9]", ""), F.lit(10)))
    spelled = keyed.groupBy("key", "shown").agg(F.count("*").alias("n"))
    best = spelled.groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("n"), "shown")).alias("b"))
    counts = keyed.groupBy("key").agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("times"))
    return counts.join(best, "key").select("key", "b.shown", "docs", "times")


@query(r"""WITH y AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\b(?:19|20)[0-9]{2}\b'), lambda x: x::INTEGER) AS y FROM documents) SELECT doc_id, list_max(y) AS latest_year FROM y WHERE len(y) > 0""")
def copyright_years(spark, sf_dir):
    years = F.regexp_extract_all("text", F.lit(r"\b(?:19|20)[0-9]{2}\b"), F.lit(0))
    return documents(spark, sf_dir).select("doc_id", F.array_max(F.transform(years, lambda y: y.cast("int"))).alias("latest_year")).where("latest_year IS NOT NULL")


#: Beginnings and endings that make a compound with one known word.
BEGINNINGS = "sub re pre un post auto multi micro macro meta mono cross inter hyper".split()
ENDINGS = "up in on out off to set grid base time store flow pack kit stack".split()


@query(rf"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS word FROM documents), v AS (SELECT word, count(*) AS n FROM w GROUP BY 1), k AS (SELECT word FROM v WHERE n >= 4),
s AS (SELECT word, i, left(word, i) AS a, substr(word, i + 1) AS b FROM v, unnest(range(2, length(word) - 1)) AS t(i) WHERE length(word) >= 5)
SELECT word, min(i)::INTEGER AS cut FROM s WHERE (a IN ({", ".join(map(lit, BEGINNINGS))}) AND length(b) > 2 AND b IN (SELECT word FROM k))
  OR (b IN ({", ".join(map(lit, ENDINGS))}) AND length(a) > 2 AND a IN (SELECT word FROM k)) OR (length(a) > 2 AND length(b) > 2 AND a IN (SELECT word FROM k) AND b IN (SELECT word FROM k)) GROUP BY 1""")
def compound_words(spark, sf_dir):
    """Words of five letters and more made of two known words, or of one and a common beginning or ending, with the first
    such cut. A word seen KNOWN times counts as known, for lack of a dictionary; both sides meet it by equality."""
    words = documents(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    words = cut_lineage(words.groupBy("word").agg(F.count("*").alias("n")))
    splits = words.where(F.length("word") >= 5).select("word", F.explode(F.sequence(F.lit(2), F.length("word") - 2)).alias("cut"))
    splits = splits.select("word", "cut", F.substring("word", F.lit(1), F.col("cut")).alias("a"), F.substring("word", F.col("cut") + 1, F.length("word")).alias("b"))
    known = words.where(F.col("n") >= KNOWN)
    first, second = (known.select(F.col("word").alias(c), F.lit(True).alias(f"known_{c}")) for c in "ab")
    met = splits.join(first, "a", "left").join(second, "b", "left")
    whole = lambda c: F.coalesce(f"known_{c}", F.lit(False)) & (F.length(c) > 2)
    fits = (F.col("a").isin(BEGINNINGS) & whole("b")) | (F.col("b").isin(ENDINGS) & whole("a")) | (whole("a") & whole("b"))
    return met.where(fits).groupBy("word").agg(F.min("cut").alias("cut"))


AUDITS = [("a", 0.3, "binary", "See [docs](https://d.org/x) for `code`"), ("b", 0.7, "numeric", "plain"), ("c", 0.95, "numeric", "[only](http://o.org)"), ("d", None, "manual", "m"), ("e", None, "numeric", "")]


@query("WITH v AS " + values(AUDITS, "id, score, mode, text") + r"""SELECT id, CASE WHEN mode IN ('informative', 'notApplicable', 'manual') OR score IS NULL THEN 'Info' WHEN score >= 0.9 THEN NULL WHEN score < 0.5 THEN 'Important' ELSE 'Optimization' END AS severity,
replace(regexp_replace(text, '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '`', '') AS text, nullif(regexp_extract(text, '\]\((https?://[^)]+)\)', 1), '') AS link FROM v""")
def lighthouse_audits(spark, sf_dir):
    rows = spark.createDataFrame(AUDITS, "id string, score double, mode string, text string")
    return rows.select("id", C.lighthouse_severity(F.col("score"), F.col("mode")).alias("severity"), C.plain_markdown(F.col("text")).alias("text"), C.first_link(F.col("text")).alias("link"))


@query("""WITH r AS (SELECT event_type, ['LCP', 'CLS', 'INP', 'TTFB', 'FCP'][event_id % 5 + 1] AS metric, CASE WHEN value <= 20 THEN 'Good' WHEN value > 60 THEN 'Poor' ELSE 'Needs improvement' END AS rating FROM events),
s AS (SELECT event_type, metric, CASE WHEN rating = 'Poor' THEN CASE WHEN metric IN ('LCP', 'CLS', 'INP') THEN 'Critical' ELSE 'Important' END
WHEN rating = 'Needs improvement' THEN CASE WHEN metric IN ('LCP', 'CLS', 'INP') THEN 'Important' ELSE 'Optimization' END END AS severity FROM r) SELECT event_type, metric, severity, count(*)::BIGINT AS n FROM s GROUP BY 1, 2, 3""")
def vitals_severity(spark, sf_dir):
    from auditloom.functions.text import rate

    names = F.array(*map(F.lit, ("LCP", "CLS", "INP", "TTFB", "FCP")))
    rows = table(spark, sf_dir, "events").select("event_type", F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("metric"), rate(F.col("value"), 20, 60).alias("rating"))
    return rows.groupBy("event_type", "metric", C.vitals_severity(F.col("metric"), F.col("rating")).alias("severity")).agg(F.count("*").alias("n"))


FIELDS = [("email", "e-mail"), ("text", "your-name"), ("tel", "x"), ("textarea", "Message"), ("checkbox", "agree"), ("text", "Company"), ("text", "zip")]


@query("WITH v AS " + values(FIELDS, "kind, name") + r"""SELECT kind, name, CASE WHEN kind = 'email' OR regexp_matches(lower(name), 'e-?mail') THEN 'email' WHEN kind = 'tel' OR regexp_matches(lower(name), 'phone|tel|mobile') THEN 'phone'
WHEN regexp_matches(lower(name), 'name') THEN 'name' WHEN regexp_matches(lower(name), 'message|comment|enquiry|inquiry') THEN 'message' WHEN regexp_matches(lower(name), 'company|organi[sz]ation') THEN 'company'
WHEN kind = 'checkbox' OR regexp_matches(lower(name), 'consent|agree|privacy') THEN 'consent' ELSE 'other' END AS purpose FROM v""")
def field_purposes(spark, sf_dir):
    return spark.createDataFrame(FIELDS, "kind string, name string").select("kind", "name", C.field_purpose(F.col("kind"), F.col("name")).alias("purpose"))


FILES = [(".env",), ("src/.env.local",), ("deploy/id_rsa",), ("node_modules/x.js",), ("a/__pycache__/b.pyc",), ("src/app.ts",), ("x/service-account-1.json",)]


@query("WITH v AS " + values(FILES, "path") + f"""SELECT path, CASE WHEN regexp_matches(path, {lit(C.SECRET_FILES)}) THEN 'secret' WHEN regexp_matches(path, {lit(C.ARTEFACTS)}) THEN 'artefact' ELSE 'source' END AS kind FROM v""")
def repo_files(spark, sf_dir):
    p = F.col("path")
    return spark.createDataFrame(FILES, "path string").select("path", F.when(p.rlike(C.SECRET_FILES), "secret").when(p.rlike(C.ARTEFACTS), "artefact").otherwise("source").alias("kind"))


@query(r"""WITH u AS (SELECT c_custkey, c_name, c_nationkey, c_mktsegment, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer),
t AS (SELECT c_nationkey, c_mktsegment, any_value(n) AS n FROM u GROUP BY 1, 2), m AS (SELECT c_nationkey, max_by(c_mktsegment, (n, c_mktsegment)) AS main, sum(n)::BIGINT AS total FROM t GROUP BY 1)
SELECT c_nationkey, main, total, (SELECT count(*) FROM t x WHERE x.c_nationkey = m.c_nationkey AND x.c_mktsegment <> m.main AND x.n * 5 < m.total)::BIGINT AS minorities FROM m""")
def consensus(spark, sf_dir):
    """The value most members of a group show, and how many other values fewer than a fifth of them show."""
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    heads = counts.groupBy("c_nationkey").agg(F.max(F.struct("n", "c_mktsegment")).alias("h"), F.sum("n").alias("total"))
    joined = counts.join(heads, "c_nationkey")
    minority = (F.col("c_mktsegment") != F.col("h.c_mktsegment")) & (F.col("n") * 5 < F.col("total"))
    return joined.groupBy("c_nationkey").agg(F.first("h.c_mktsegment").alias("main"), F.first("total").alias("total"), F.count_if(minority).alias("minorities"))


ROBOTS = (
    "User-agent: one\nUser-agent: *  # everyone\nAllow: /en/12\nDisallow: /en/1\nDisallow: /de/\nSitemap: http://a.com/s.xml\n\nDisallow: /fr/\n\nUser-agent: two\nDisallow: /",
    "User-agent: *\nDisallow:\n",
    "User-agent: *\nDisallow: /es/\nAllow: /en/4\nDisallow: /en/4\nDisallow: /en/5",
)


@query("WITH " + URL_SQL + r"""SELECT DISTINCT bare_host AS host, raw_path AS path, CASE length(bare_host) % 4
  WHEN 0 THEN starts_with(raw_path, '/en/12') OR NOT (starts_with(raw_path, '/en/1') OR starts_with(raw_path, '/de/'))
  WHEN 2 THEN NOT (starts_with(raw_path, '/es/') OR starts_with(raw_path, '/en/5')) ELSE true END AS allowed FROM urls""")
def robots_allowed(spark, sf_dir):
    """Paths of stored pages against their host's robots file, one of three (or none) laid over the hosts by the length of
    their names: the first fitting rule of the group decides; rules outside a group do not count."""
    from auditloom.sources import tables

    paths = table(spark, sf_dir, "pages").select(U.bare_host(F.col("url")).alias("host"), U.raw_path(F.col("url")).alias("path")).distinct()
    body = F.get(F.array(*map(F.lit, ROBOTS)), F.length("host") % 4)
    files = paths.select("host", body.alias("body")).distinct().where("body IS NOT NULL")
    return tables.robots_allowed(paths, tables.robots_rules(files)).select("host", "path", "allowed")


@query(r"""SELECT url AS loc, CASE WHEN page_id % 2 = 0 THEN '2026-01-0' || (page_id % 9 + 1)::VARCHAR END AS lastmod FROM pages""")
def sitemap_xml(spark, sf_dir):
    """A sitemap built from the stored urls and read back."""
    from auditloom.sources import tables

    when = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<lastmod>2026-01-0"), (F.col("page_id") % 9 + 1).cast("string"), F.lit("</lastmod>"))).otherwise("")
    xml = table(spark, sf_dir, "pages").select(F.concat(F.lit("<urlset><url><loc> "), "url", F.lit(" </loc>"), when, F.lit("</url></urlset>")).alias("xml"))
    return tables.sitemap_entries(xml)


@query(r"""SELECT url, (length(body) - length(replace(body, '<p>', ''))) // 3 AS paragraphs, (length(body) - length(replace(body, '<li>', ''))) // 4 AS items FROM (
  SELECT url, regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gis'), '<script\b.*?</script>', '', 'gis'), '<style\b.*?</style>', '', 'gis') AS body FROM pages)""")
def element_counts(spark, sf_dir):
    """Paragraphs and list items of each page, from the parsed element table; pages of one url are counted apart, a page
    without elements has none, one without html unknown numbers."""
    from auditloom.sources.elements import html_elements

    pages, tags = table(spark, sf_dir, "pages"), {"paragraphs": "p", "items": "li"}
    counted = html_elements(pages, ("page_id", "url")).select("page_id", "url", *[F.when(F.col("tag") == t, 1).otherwise(0).alias(c) for c, t in tags.items()])
    given = pages.select("page_id", "url", *[F.when(F.col("html").isNotNull(), 0).alias(c) for c in tags])
    return counted.unionByName(given).groupBy("page_id", "url").agg(*[F.sum(c).alias(c) for c in tags]).select("url", *tags)


@query()
def page_element_issues(spark, sf_dir):
    """Heading, image, accessibility and social issues of all pages, from one parse; nesting is not SQL."""
    from auditloom.operators import element_rules as E
    from auditloom.sources.elements import html_elements

    rows = cut_lineage(html_elements(table(spark, sf_dir, "pages")))
    out = E.heading_rules(rows)
    for rules in (E.image_rules, E.accessibility_rules, E.social_rules):
        out = out.unionByName(rules(rows))
    return out
