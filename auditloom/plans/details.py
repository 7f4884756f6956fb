"""Smaller operators: title suffixes, default titles, fragments, header keys, robots metas, messages, spellings."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions import classify as C
from auditloom.functions import html as H
from auditloom.functions import urls as U
from auditloom.operators import metrics
from auditloom.operators.element_rules import missing_fragments as missing_fragments_of
from auditloom.operators.report_rules import EXPECTED
from auditloom.operators.report_rules import expected_types as report_expected

from .onpage import FACTS_SQL, URL_SQL, facts
from .registry import query, table
from .scalars import values


@query("WITH " + FACTS_SQL + r""", p AS (SELECT url, string_split_regex(title, '\s[|–—-]\s') AS parts FROM facts),
s AS (SELECT url, CASE WHEN len(parts) > 1 THEN parts[-1] ELSE '' END AS suffix FROM p), n AS (SELECT suffix, count(*)::BIGINT AS pages FROM s GROUP BY 1)
SELECT suffix, pages, pages >= 0.3 * (SELECT count(*) FROM pages) AS is_brand FROM n""")
def title_suffixes(spark, sf_dir):
    """What follows the last separator of titles; a brand if on at least 30 % of the pages."""
    parts = F.split("title", r"\s[|–—-]\s")
    rows = facts(spark, sf_dir).select(F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise("").alias("suffix"))
    counts = rows.groupBy("suffix").agg(F.count("*").alias("pages"))
    total = rows.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total)).select("suffix", "pages", (F.col("pages") >= F.col("total") * 0.3).alias("is_brand"))


@query("WITH " + FACTS_SQL + "," + URL_SQL + r""", t AS (SELECT facts.url, bare_host, title, path FROM facts JOIN urls USING (page_id)),
h AS (SELECT bare_host, min_by(title, (length(path), path, title)) AS home FROM t GROUP BY 1)
SELECT url, title FROM t JOIN h USING (bare_host) WHERE title = home AND title <> '' AND (bare_host, path) NOT IN (SELECT bare_host, min_by(path, (length(path), path)) FROM t GROUP BY 1)""")
def default_titles(spark, sf_dir):
    """Pages with the title of their site's shortest path, which stands for the home page."""
    rows = facts(spark, sf_dir).select("url", "title", U.bare_host(F.col("url")).alias("host"), U.path(F.col("url")).alias("path"))
    first = F.min(F.struct(F.length("path").alias("n"), "path", "title"))
    homes = rows.groupBy("host").agg(first.alias("h")).select("host", F.col("h.path").alias("home_path"), F.col("h.title").alias("home"))
    joined = rows.join(homes, "host")
    return joined.where((F.col("title") == F.col("home")) & (F.col("title") != "") & (F.col("path") != F.col("home_path"))).select("url", "title")


@query("WITH " + FACTS_SQL + r""", k AS (SELECT md5(regexp_replace(regexp_extract(body, '(?is)<nav\b.*?</nav>'), '\s(class|id|style|data-[a-z-]+|aria-[a-z-]+|href)="[^"]*"', '', 'g')) AS header_key FROM facts)
SELECT header_key, count(*)::BIGINT AS pages FROM k GROUP BY 1 HAVING count(*) > 1""")
def distinct_headers(spark, sf_dir):
    """Navigation blocks that several pages share once volatile attributes are gone."""
    nav = F.regexp_extract(H.stripped(F.col("html")), r"(?is)(<nav\b.*?</nav>)", 1)
    key = F.md5(F.regexp_replace(nav, r'\s(class|id|style|data-[a-z-]+|aria-[a-z-]+|href)="[^"]*"', "").cast("binary"))
    return table(spark, sf_dir, "pages").groupBy(key.alias("header_key")).agg(F.count("*").alias("pages")).where("pages > 1")


METAS = [("a", "noindex, follow"), ("b", "none"), ("c", " NONE ,nofollow"), ("d", "index"), ("e", ""), ("f", None), ("g", "max-snippet:-1, noindex")]


@query("WITH v AS " + values(METAS, "url, content") + r"""SELECT url, contains(lower(coalesce(content, '')), 'noindex') OR list_contains(list_transform(string_split(lower(coalesce(content, '')), ','), lambda x: trim(x)), 'none') AS noindex FROM v""")
def meta_robots(spark, sf_dir):
    return spark.createDataFrame(METAS, "url string, content string").select("url", C.noindex(F.col("content")).alias("noindex"))


MESSAGES = [("u1", "Element “div” not allowed as child of “span”."), ("u2", "Element “p” not allowed as child of “b”."), ("u2", "Bad value “x” for attribute “y”."), ("u3", "Element “p” not allowed as child of “b”.")]


@query("WITH v AS " + values(MESSAGES, "url, message") + r"""SELECT regexp_replace(message, '“[^”]*”', '…', 'g') AS grouped, count(*)::BIGINT AS messages, count(DISTINCT url)::BIGINT AS pages FROM v GROUP BY 1""")
def validator_messages(spark, sf_dir):
    """Validator messages that differ only in what they quote, counted together."""
    rows = spark.createDataFrame(MESSAGES, "url string, message string")
    return rows.groupBy(C.grouped_message(F.col("message")).alias("grouped")).agg(F.count("*").alias("messages"), F.count_distinct("url").alias("pages"))


SPELLINGS = [("organise", "organize"), ("colour", "color"), ("centre", "center"), ("analyse", "analyze"), ("catalogue", "catalog"), ("travelling", "traveling"), ("house", "horse"), ("grey", "gray"), ("licence", "license")]


@query("WITH v AS " + values(SPELLINGS, "word, suggestion") + r"""SELECT word, suggestion, suggestion IN (regexp_replace(word, 'is(e|ed|es|ing|ation)$', 'iz\1'), regexp_replace(word, 'our', 'or'), regexp_replace(word, 'tre$', 'ter'),
regexp_replace(word, 'ys(e|ed|es|ing)$', 'yz\1'), regexp_replace(word, 'ogue$', 'og'), regexp_replace(word, 'll(ed|ing|er)$', 'l\1'), regexp_replace(word, 'ence$', 'ense'), replace(word, 'grey', 'gray')) AND word <> suggestion AS british FROM v""")
def british_variants(spark, sf_dir):
    """Whether a suggestion is only the American form of the word."""
    return spark.createDataFrame(SPELLINGS, "word string, suggestion string").select("word", "suggestion", C.british_variant(F.col("word"), F.col("suggestion")).alias("british"))


@query(r"""WITH r AS (SELECT o_custkey, o_orderkey, nullif(o_orderpriority, '4-NOT SPECIFIED') AS p, nullif(o_orderstatus, 'O') AS s FROM orders)
SELECT o_custkey, min_by(p, o_orderkey) FILTER (p IS NOT NULL) AS first_priority, min_by(s, o_orderkey) FILTER (s IS NOT NULL) AS first_status FROM r GROUP BY 1""")
def first_known(spark, sf_dir):
    """The first non-empty value of each column in row order, as one partial aggregation."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("p"), F.nullif("o_orderstatus", F.lit("O")).alias("s"))
    return metrics.first_known(rows, "o_custkey", "o_orderkey", {"p": "first_priority", "s": "first_status"})


FRAGMENTS = [("p", "a", "top"), ("p", "id", "top"), ("p", "a", "gone"), ("q", "id", "gone"), ("q", "a", "x"), ("q", "name", "x")]


@query("WITH v AS " + values(FRAGMENTS, "url, kind, ref") + r"""SELECT url, ref FROM v a WHERE kind = 'a' AND NOT EXISTS (SELECT 1 FROM v b WHERE b.url = a.url AND b.ref = a.ref AND b.kind <> 'a')""")
def missing_fragments(spark, sf_dir):
    """In-page links to an id or name that the page does not have."""
    return missing_fragments_of(spark.createDataFrame(FRAGMENTS, "url string, kind string, ref string"))


IMAGES = [("/_next/image?url=%2Fimg%2Fa%20b.png&w=640", 640, 1280), ("/x/y.jpg?v=1", 100, 500), ("z.webp", None, 10)]


@query("WITH v AS " + values(IMAGES, "src, width, natural_width") + r"""SELECT src, string_split(regexp_replace(CASE WHEN contains(src, '/_next/image?') THEN url_decode(regexp_extract(src, '[?&]url=([^&]*)', 1)) ELSE src END, '[?#].*$', ''), '/')[-1] AS name,
coalesce(natural_width > 2.5 * width, false) AS oversized FROM v""")
def image_names(spark, sf_dir):
    """The file behind an image optimiser's url, and images much larger than they are shown."""
    rows = spark.createDataFrame(IMAGES, "src string, width int, natural_width int")
    return rows.select("src", C.image_file(F.col("src")).alias("name"), C.oversized(F.col("natural_width"), F.col("width")).alias("oversized"))


@query("WITH " + URL_SQL + "SELECT url, CASE " + " ".join(f"WHEN regexp_matches(path, '{p}') THEN '{label}'" for p, _, label in EXPECTED) + " END AS expected FROM urls")
def expected_types(spark, sf_dir):
    """The structured data that each page's path asks for; null if none."""
    return table(spark, sf_dir, "pages").select("url", report_expected(U.path(F.col("url")))["label"].alias("expected"))


@query(r"""WITH e AS (SELECT user_id, event_type, props, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT user_id, string_agg(event_type, '>' ORDER BY rn)::VARCHAR AS last_three FROM e WHERE rn <= 3 GROUP BY 1""")
def recent_history(spark, sf_dir):
    """The last three kinds of event of each user, newest first: top rows first, so that lists stay short."""
    return metrics.recent(table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], "event_type", 3, "last_three")
