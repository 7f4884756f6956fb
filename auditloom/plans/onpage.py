"""Rules over single pages and over their urls, titles and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.functions import html as H
from auditloom.functions import text as T
from auditloom.functions import urls as U
from auditloom.operators import scoring
from auditloom.operators.rules import Rule, evaluate
from auditloom.operators.sized import running_total, sized_join

from .registry import query, table

TITLE_MIN, TITLE_MAX = 30, 60

#: SQL of the page facts that several queries start from.
FACTS_SQL = r"""
stripped AS (
  SELECT page_id, url, html,
    regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->', ' ', 'gis'),
      '<script\b.*?</script>', ' ', 'gis'), '<style\b.*?</style>', ' ', 'gis') AS body
  FROM pages
), raw AS (
  SELECT *, regexp_extract(body, '<title(?:\s[^>]*)?>(.*?)</title>', 1, 'is') AS title_html,
    regexp_extract(body, '<h1(?:\s[^>]*)?>(.*?)</h1>', 1, 'is') AS h1_html
  FROM stripped
), facts AS (
  SELECT page_id, url, html, body,
    trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(title_html, '<[^>]*>', ' ', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g')) AS title,
    trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(h1_html, '<[^>]*>', ' ', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g')) AS h1
  FROM raw
)"""

URL_SQL = r"""
parts AS (
  SELECT page_id, url, lower(regexp_extract(url, '^(?:([^:/?#]+):)?', 1)) AS scheme,
    lower(regexp_extract(url, '^(?:[^:/?#]+:)?//([^/?#]*)', 1)) AS host,
    regexp_extract(url, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1) AS raw_path,
    regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q
  FROM pages
), urls AS (
  SELECT *, regexp_replace(host, '^www\.', '') AS bare_host,
    CASE WHEN regexp_replace(raw_path, '/+$', '') = '' THEN '/' ELSE regexp_replace(raw_path, '/+$', '') END AS path
  FROM parts
)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", "html", H.text_of(H.element(F.col("html"), "title")).alias("title"), H.text_of(H.element(F.col("html"), "h1")).alias("h1"))


def title_pack() -> list[Rule]:
    return [
        Rule("Critical", "Title", "Title missing", F.col("title") == ""),
        Rule("Important", "Title", "Title too short", (F.col("title") != "") & (F.length("title") < TITLE_MIN), F.col("title")),
        Rule("Important", "Title", "Title too long", F.length("title") > TITLE_MAX, F.col("title")),
        Rule("Critical", "Title", "Duplicate title", F.col("n_same") > 1, F.col("title")),
    ]


def h1_pack() -> list[Rule]:
    return [
        Rule("Critical", "H1", "Missing H1", F.col("n_h1") == 0),
        Rule("Critical", "H1", "Empty H1", (F.col("n_h1") > 0) & (F.col("h1") == "")),
        Rule("Important", "H1", "H1 too short to be meaningful", (F.col("h1") != "") & (F.length("h1") < 10), F.col("h1")),
        Rule("Optimization", "H1", "H1 identical to title", (F.col("h1") != "") & (F.lower(F.trim("h1")) == F.lower(F.trim("title"))), F.col("h1")),
        Rule("Optimization", "H2", "No H2 sub-headings", F.col("n_h2") == 0),
    ]


def counted_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with numbers of headings and of pages with the same title; pages without a title stand alone."""
    counted = facts(spark, sf_dir).withColumns({"n_h1": H.count_elements(F.col("html"), "h1"), "n_h2": H.count_elements(F.col("html"), "h2"), "title_key": F.lower(F.trim("title"))})
    return sized_join(counted.drop("html"), _same_titles(counted), "title_key", "left").withColumn("n_same", F.coalesce("n_same", F.lit(1))).drop("title_key")


def _same_titles(rows: DataFrame) -> DataFrame:
    """(title_key, n_same) of titles that several pages have: partial sums, so that one title of a whole site is no task's."""
    return rows.where("title_key <> ''").groupBy("title_key").agg(F.count("*").alias("n_same")).where("n_same > 1")


def page_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and H1 issues of all pages: one pass over the pages, one shuffle for the duplicate titles."""
    return evaluate(counted_facts(spark, sf_dir), [*title_pack(), *h1_pack()], report="02_page_seo")


ISSUES_SQL = FACTS_SQL + r""", counted AS (
  SELECT *, len(regexp_extract_all(body, '(?i)<h1[\s>]')) AS n_h1, len(regexp_extract_all(body, '(?i)<h2[\s>]')) AS n_h2,
    CASE WHEN trim(title) <> '' THEN count(*) OVER (PARTITION BY lower(trim(title))) ELSE 1 END AS n_same
  FROM facts
), issues AS (
  SELECT url, 'Critical' AS severity, 'Title' AS category, 'Title missing' AS issue, '' AS current_value FROM counted WHERE title = ''
  UNION ALL SELECT url, 'Important', 'Title', 'Title too short', title FROM counted WHERE title <> '' AND length(title) < 30
  UNION ALL SELECT url, 'Important', 'Title', 'Title too long', title FROM counted WHERE length(title) > 60
  UNION ALL SELECT url, 'Critical', 'Title', 'Duplicate title', title FROM counted WHERE n_same > 1
  UNION ALL SELECT url, 'Critical', 'H1', 'Missing H1', '' FROM counted WHERE n_h1 = 0
  UNION ALL SELECT url, 'Critical', 'H1', 'Empty H1', '' FROM counted WHERE n_h1 > 0 AND h1 = ''
  UNION ALL SELECT url, 'Important', 'H1', 'H1 too short to be meaningful', h1 FROM counted WHERE h1 <> '' AND length(h1) < 10
  UNION ALL SELECT url, 'Optimization', 'H1', 'H1 identical to title', h1 FROM counted WHERE h1 <> '' AND lower(trim(h1)) = lower(trim(title))
  UNION ALL SELECT url, 'Optimization', 'H2', 'No H2 sub-headings', '' FROM counted WHERE n_h2 = 0
)"""


@query("WITH " + ISSUES_SQL + r"""
, d AS (SELECT DISTINCT url, severity, issue FROM issues WHERE category = 'Title'),
s AS (
  SELECT p.url, greatest(0, 100 - coalesce(sum(CASE d.severity WHEN 'Critical' THEN 25 WHEN 'Important' THEN 8 WHEN 'Optimization' THEN 2 ELSE 0 END), 0))::DOUBLE AS score
  FROM (SELECT DISTINCT url FROM pages) p LEFT JOIN d USING (url) GROUP BY p.url
)
SELECT url, score, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 80 THEN 'Good' WHEN score >= 70 THEN 'Needs Improvement' WHEN score >= 50 THEN 'Poor' ELSE 'Critical' END AS grade FROM s
""")
def page_score(spark, sf_dir):
    issues = page_issues(spark, sf_dir).where("category = 'Title'")
    return scoring.page_scores(table(spark, sf_dir, "pages").select("url").distinct(), issues)


@query("WITH " + ISSUES_SQL + " SELECT url, severity, category, issue, current_value FROM issues")
def page_seo_issues(spark, sf_dir):
    return page_issues(spark, sf_dir).select("url", "severity", "category", "issue", "current_value")


@query("WITH " + ISSUES_SQL + " SELECT url, issue, length(current_value)::BIGINT AS n_chars FROM issues WHERE category = 'Title' AND issue <> 'Duplicate title'")
def title_rules(spark, sf_dir):
    rows = facts(spark, sf_dir).withColumn("n_same", F.lit(1))
    return evaluate(rows, title_pack()[:3]).select("url", "issue", F.length("current_value").cast("long").alias("n_chars"))


@query("WITH " + FACTS_SQL + r""", same AS (
  SELECT url, title, count(*) OVER (PARTITION BY lower(trim(title))) AS n_pages FROM facts WHERE trim(title) <> ''
) SELECT url, title, n_pages::BIGINT AS n_pages FROM same WHERE n_pages > 1""")
def duplicate_titles(spark, sf_dir):
    rows = facts(spark, sf_dir).select("url", "title", F.lower(F.trim("title")).alias("title_key")).where("title_key <> ''")
    return sized_join(rows, _same_titles(rows), "title_key").select("url", "title", F.col("n_same").alias("n_pages"))


def _listed(problems: list[tuple]) -> F.Column:
    """Problem names whose condition holds, one row each."""
    return F.explode(F.array_compact(F.array(*[F.when(c, name) for name, c in problems])))


@query("WITH " + URL_SQL + r"""
SELECT url, unnest(list_filter([
  CASE WHEN path <> lower(path) THEN 'uppercase' END, CASE WHEN contains(path, '_') THEN 'underscores' END,
  CASE WHEN regexp_matches(path, '(?i)%[0-9a-f]{2}|\s') THEN 'encoded characters' END, CASE WHEN length(path) > 75 THEN 'long' END,
  CASE WHEN length(path) - length(replace(path, '/', '')) > 3 THEN 'deep' END,
  CASE WHEN regexp_matches(path, '[0-9]{5,}|[a-f0-9]{12,}') THEN 'IDs/hashes instead of words' END,
  CASE WHEN contains(url, '?') THEN 'query parameters' END], lambda x: x IS NOT NULL)) AS problem
FROM urls""")
def url_friendliness(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("url", U.path(F.col("url")).alias("path"))
    return rows.select("url", _listed(url_problems(F.col("path"), F.col("url"))).alias("problem"))


def url_problems(p, url) -> list[tuple]:
    """What makes a url unfriendly, with the condition for it."""
    return [
        ("uppercase", p != F.lower(p)), ("underscores", p.contains("_")), ("encoded characters", p.rlike(r"(?i)%[0-9a-f]{2}|\s")), ("long", F.length(p) > 75),
        ("deep", F.regexp_count(p, F.lit("/")) > 3), ("IDs/hashes instead of words", p.rlike("[0-9]{5,}|[a-f0-9]{12,}")), ("query parameters", url.contains("?")),
    ]


@query("WITH " + URL_SQL + r"""
SELECT url, unnest(list_filter([
  CASE WHEN path <> lower(path) THEN 'uppercase letters' END, CASE WHEN contains(path, '_') THEN 'underscores' END,
  CASE WHEN regexp_matches(path, '%[0-9A-Fa-f]{2}|\s') THEN 'encoded / space characters' END, CASE WHEN length(path) > 75 THEN 'long path' END,
  CASE WHEN length(path) - length(replace(path, '/', '')) > 4 THEN 'deep path' END, CASE WHEN regexp_matches(path, '\.(html?|php|aspx?)$') THEN 'file extension' END,
  CASE WHEN regexp_matches(path, '--|-$') THEN 'double / trailing hyphen' END, CASE WHEN q <> '' THEN 'query string' END], lambda x: x IS NOT NULL)) AS problem
FROM urls""")
def slug_problems(spark, sf_dir):
    p = F.col("path")
    rows = table(spark, sf_dir, "pages").select("url", U.path(F.col("url")).alias("path"), U.query(F.col("url")).alias("q"))
    problems = [
        ("uppercase letters", p != F.lower(p)), ("underscores", p.contains("_")), ("encoded / space characters", p.rlike(r"%[0-9A-Fa-f]{2}|\s")), ("long path", F.length(p) > 75),
        ("deep path", F.regexp_count(p, F.lit("/")) > 4), ("file extension", p.rlike(r"\.(html?|php|aspx?)$")), ("double / trailing hyphen", p.rlike("--|-$")), ("query string", F.col("q") != ""),
    ]
    return rows.select("url", _listed(problems).alias("problem"))


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


@query("WITH " + FACTS_SQL + "," + URL_SQL + rf""", w AS (
  SELECT facts.url, title,
    list_distinct(list_filter(string_split_regex(lower(path), '[-/_]'), lambda x: length(x) > 2 AND NOT list_contains({STOP_SQL}, x))) AS topic,
    list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9.+#]+'), lambda x: length(x) > 2 AND NOT list_contains({STOP_SQL}, x))) AS words
  FROM facts JOIN urls USING (page_id)
) SELECT url, array_to_string(list_sort(topic), ' ') AS topic, title FROM w WHERE len(topic) > 0 AND title <> '' AND NOT list_has_any(topic, words)""")
def topic_not_in_title(spark, sf_dir):
    rows = facts(spark, sf_dir).select("url", "title", T.slug_words(U.path(F.col("url"))).alias("topic"), T.topic_words(F.col("title")).alias("words"))
    rows = rows.where((F.size("topic") > 0) & (F.col("title") != "") & ~F.arrays_overlap("topic", "words"))
    return rows.select("url", F.array_join(F.array_sort("topic"), " ").alias("topic"), "title")


@query("WITH " + URL_SQL + r"""
SELECT url, scheme || '://' || host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS norm, path,
  path || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS path_key, bare_host FROM urls""")
def url_normal_forms(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("url", U.norm(u).alias("norm"), U.path(u).alias("path"), U.path_key(u).alias("path_key"), U.bare_host(u).alias("bare_host"))


CLEAN_SQL = r"""scheme || '://' || host || CASE WHEN raw_path = '' THEN '/' ELSE raw_path END
  || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END"""


#: Every url of `urls` with its crawl identity, `clean_url`.
KEPT_SQL = r""", k AS (
  SELECT *, array_to_string(list_filter(string_split(q, '&'), lambda kv: kv <> '' AND NOT regexp_matches(lower(string_split(kv, '=')[1]),
    '^(utm_[a-z_]+|fbclid|gclid|dclid|gbraid|wbraid|msclkid|mc_cid|mc_eid|_ga|_gl|igshid|ref_src|_rsc)$')), '&') AS kept FROM urls
), cleaned AS (SELECT *, """ + CLEAN_SQL + """ AS clean_url FROM k)"""


@query("WITH " + URL_SQL + KEPT_SQL + " SELECT clean_url, count(*)::BIGINT AS n FROM cleaned GROUP BY 1")
def clean_url_dedupe(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(U.clean(F.col("url")).alias("clean_url")).agg(F.count("*").alias("n"))


@query("WITH " + URL_SQL + r""", v AS (
  SELECT DISTINCT url FROM (SELECT url FROM urls UNION ALL SELECT upper(url) FROM urls WHERE page_id % 7 = 0)
), p AS (SELECT url, lag(url) OVER (PARTITION BY lower(url) ORDER BY url) AS prev_url FROM v)
SELECT url, prev_url FROM p WHERE prev_url IS NOT NULL AND prev_url <> url""")
def sitemap_case_variants(spark, sf_dir):
    """Entries that differ from the previous spelling of the same url only by case; every seventh page is listed twice."""
    pages = table(spark, sf_dir, "pages")
    entries = pages.select("url").union(pages.where("page_id % 7 = 0").select(F.upper("url"))).distinct()
    before = F.lag("url").over(Window.partitionBy(F.lower("url")).orderBy("url"))
    return entries.withColumn("prev_url", before).where("prev_url IS NOT NULL AND prev_url <> url")


@query("WITH " + URL_SQL + r""", s AS (
  SELECT page_id, url, bare_host, q, list_filter(string_split(raw_path, '/'), lambda x: x <> '') AS seg FROM urls
), t AS (
  SELECT page_id, url, bare_host, (len(seg) <= 1 AND q = '') AS top_level, coalesce(seg[1], '?') AS section FROM s
), r AS (
  SELECT *, row_number() OVER (PARTITION BY bare_host, section, top_level ORDER BY page_id) AS rn FROM t
) SELECT url, section, rn::BIGINT AS rn FROM r WHERE top_level OR rn <= 2""")
def section_sample(spark, sf_dir):
    u = F.col("url")
    rows = table(spark, sf_dir, "pages").select("page_id", "url", U.bare_host(u).alias("host"), U.segments(u).alias("seg"), U.query(u).alias("q"))
    rows = rows.withColumn("top_level", (F.size("seg") <= 1) & (F.col("q") == "")).withColumn("section", F.coalesce(F.try_element_at("seg", F.lit(1)), F.lit("?")))
    # of the others, a limit on the row number is taken in every task before the shuffle; all top-level ones are numbered by ranges
    nth = F.row_number().over(Window.partitionBy("host", "section").orderBy("page_id")).cast("long")
    few = rows.where("NOT top_level").withColumn("rn", nth).where("rn <= 2").select("url", "section", "rn")
    keyed = rows.where("top_level").withColumn("part", F.concat_ws("/", "host", "section"))
    top = running_total(keyed, "part", [F.col("page_id").asc()], F.lit(1)).select("url", "section", (F.col("before") + 1).alias("rn"))
    return few.unionByName(top)


@query("WITH " + FACTS_SQL + r""" SELECT lower(regexp_extract(body, '<html\s[^>]*?lang="([^"]*)"', 1, 'is')) AS lang, count(*)::BIGINT AS pages FROM facts GROUP BY 1""")
def html_lang(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(F.lower(H.attribute(F.col("html"), "html", "lang")).alias("lang")).agg(F.count("*").alias("pages"))


@query("WITH " + FACTS_SQL + r""", t AS (SELECT url, title AS text, 'title' AS place FROM facts UNION ALL SELECT url, h1, 'h1' FROM facts),
l AS (SELECT *, regexp_replace(text, '[^A-Za-z]', '', 'g') AS letters FROM t)
SELECT url, place, unnest(list_filter([
  CASE WHEN letters = upper(letters) AND len(list_filter(regexp_extract_all(text, '[A-Z]{2,}'), lambda x: length(x) > 5)) > 0 THEN 'ALL CAPS' END,
  CASE WHEN letters = lower(letters) THEN 'all lowercase' END, CASE WHEN text <> trim(text) OR contains(text, '  ') THEN 'extra spaces' END], lambda x: x IS NOT NULL)) AS problem
FROM l WHERE length(letters) >= 8""")
def letter_case(spark, sf_dir):
    rows = facts(spark, sf_dir).select("url", F.explode(F.create_map(F.lit("title"), F.col("title"), F.lit("h1"), F.col("h1"))).alias("place", "text"))
    rows = rows.withColumn("letters", F.regexp_replace("text", "[^A-Za-z]", "")).where(F.length("letters") >= 8)
    shouted = F.exists(F.regexp_extract_all("text", F.lit("[A-Z]{2,}"), F.lit(0)), lambda w: F.length(w) > 5)
    problems = [("ALL CAPS", (F.col("letters") == F.upper("letters")) & shouted), ("all lowercase", F.col("letters") == F.lower("letters")), ("extra spaces", (F.col("text") != F.trim("text")) | F.col("text").contains("  "))]
    return rows.select("url", "place", _listed(problems).alias("problem"))


@query("WITH " + FACTS_SQL + r""", w AS (SELECT url, regexp_extract_all(lower(title), '[a-z0-9]+') AS w FROM facts),
x AS (SELECT url, unnest(w) AS word, len(w) AS total FROM w)
SELECT url, word, count(*)::BIGINT AS n FROM x WHERE total >= 4 AND length(word) > 1 GROUP BY url, word HAVING count(*) >= 3""")
def keyword_stuffing(spark, sf_dir):
    words = F.regexp_extract_all(F.lower("title"), F.lit("[a-z0-9]+"), F.lit(0))
    rows = facts(spark, sf_dir).withColumn("w", words).where(F.size("w") >= 4).select("url", F.explode("w").alias("word"))
    return rows.where(F.length("word") > 1).groupBy("url", "word").agg(F.count("*").alias("n")).where("n >= 3")


@query("WITH " + FACTS_SQL + r""", t AS (
  SELECT url, array_to_string(list_filter(string_split_regex(trim(regexp_replace(regexp_replace(regexp_replace(body, '<nav\b.*?</nav>', ' ', 'gis'), '<head\b.*?</head>', ' ', 'gis'),
    '<footer\b.*?</footer>', ' ', 'gis')), '<[^>]*>'), lambda x: true), ' ') AS text FROM facts
), n AS (SELECT url, len(regexp_extract_all(text, '[^ \t\n\r]+'))::BIGINT AS words FROM t)
SELECT url, words, CASE WHEN words < 50 THEN 'Empty page (almost no text)' WHEN words < 150 THEN 'Very short page' WHEN words < 300 THEN 'Thin content' END AS length_class FROM n""")
def main_word_counts(spark, sf_dir):
    body = H.stripped(F.col("html"))
    for tag in ("nav", "head", "footer"):
        body = F.regexp_replace(body, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    rows = table(spark, sf_dir, "pages").select("url", T.word_count(F.regexp_replace(body, "<[^>]*>", " ")).alias("words"))
    return rows.select("url", "words", T.length_class(F.col("words")).alias("length_class"))
