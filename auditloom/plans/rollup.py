"""Roll-ups of issues: caps, types, summaries, ids, merged reports, category and health scores, checklist, verdict."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from auditloom.functions import text as T
from auditloom.functions import urls as U
from auditloom.operators import guide, scoring
from auditloom.operators.graph import cut_lineage
from auditloom.operators.rules import Rule, evaluate

from .onpage import ISSUES_SQL, URL_SQL, counted_facts, h1_pack, title_pack, url_problems
from .registry import query, table

#: Categories of the health score with their weights and reports.
CATEGORIES = [
    ("Technical SEO", 15, ["01_sitemap", "09_technical", "08_hreflang", "13_nextjs", "25_html_validation"]),
    ("On-Page SEO", 15, ["02_page_seo", "03_headings", "06_social", "17_heading_order", "20_seo_report", "26_text_quality"]),
    ("Performance", 15, ["12_performance", "12a_cwv", "16_third_party", "27_assets"]),
    ("Accessibility", 10, ["10_accessibility"]),
    ("Security", 8, ["11_security"]),
    ("Image", 7, ["04_images", "18_image_alt"]),
    ("Link Health", 10, ["05_links", "19_third_party_urls"]),
    ("Structured Data", 5, ["07_schema"]),
    ("Mobile", 10, ["15_mobile"]),
    ("Content", 5, ["14_content", "31_english"]),
    ("Lighthouse", 10, ["12b_lighthouse"]),
    ("Business info & Forms", 8, ["22_business_info", "23_forms"]),
    ("Navigation", 7, ["24_navigation"]),
    ("Code & Repo", 5, ["28_repo"]),
    ("Migration (live vs dev)", 5, ["29_live_vs_dev"]),
]
#: Checks (id, kind, severities that fail) and their sources (id, report, issue, category, exclude).
CHECKS = [
    ("SEO-01", "AUTO", ["Critical", "Important"]), ("SEO-04", "AUTO", ["Critical", "Important"]), ("NAV-11", "AUTO", ["Critical", "Important"]),
    ("NAV-02", "AUTO", ["Critical"]), ("CTX-01", "HUMAN", ["Critical", "Important"]), ("SEO-03", "HUMAN", ["Critical", "Important"]),
]
SOURCES = [
    ("SEO-01", "02_page_seo", None, "^(title|description)$", None), ("SEO-04", "02_page_seo", None, "^h1$", None), ("SEO-04", "17_heading_order", None, None, None),
    ("NAV-11", "09_technical", None, "^urls$", None), ("NAV-11", "url_report", "url not seo", None, None), ("NAV-02", "05_links", "broken external", None, None),
    ("NAV-02", "19_third_party_urls", "broken|error|timeout|ssl", None, None),
]
HUMAN = [("SEO-03", "pass", "")]
#: Url patterns of third-party vendors, the first match counts.
VENDORS = [
    (r"google-analytics\.com|analytics\.google\.com|/gtag/js", "Google Analytics"), (r"googletagmanager\.com", "Google Tag Manager"), (r"hotjar\.com|hotjar\.io", "Hotjar"),
    (r"connect\.facebook\.net|facebook\.com/tr", "Meta (Facebook) Pixel"), (r"snap\.licdn\.com|linkedin\.com|licdn\.com", "LinkedIn"),
    (r"youtube\.com|ytimg\.com|youtube-nocookie\.com", "YouTube"), (r"fonts\.googleapis\.com|fonts\.gstatic\.com", "Google Fonts"),
    (r"google\.com/recaptcha|gstatic\.com/recaptcha|recaptcha\.net", "Google reCAPTCHA"), (r"maps\.googleapis\.com|google\.com/maps|maps\.gstatic\.com", "Google Maps"),
    (r"doubleclick\.net|googlesyndication\.com|googleadservices\.com", "Google Ads"), (r"clarity\.ms", "Microsoft Clarity"),
    (r"cdn\.jsdelivr\.net|unpkg\.com|cdnjs\.cloudflare\.com", "Public CDN"), (r"calendly\.com", "Calendly"), (r"intercom|crisp\.chat|tawk\.to|zendesk|hubspot", "Chat / CRM widget"),
    (r"vimeo\.com", "Vimeo"), (r"images\.unsplash\.com|pexels\.com|cloudinary\.com|imgix\.net", "Image CDN"), (r"stripe\.com|paypal\.com|razorpay\.com", "Payments"),
    (r"twitter\.com|x\.com|twimg\.com", "X / Twitter"),
]


def vendor(url):
    """The first vendor whose pattern occurs in the url, else Other: one CASE, no join."""
    out = F.lit("Other")
    for pattern, name in reversed(VENDORS):
        out = F.when(F.lower(url).rlike(pattern), name).otherwise(out)
    return out


BOTH_SQL = "WITH " + ISSUES_SQL + "," + URL_SQL + r""", u AS (
  SELECT url, unnest(list_filter([
    CASE WHEN path <> lower(path) THEN 'uppercase' END, CASE WHEN contains(path, '_') THEN 'underscores' END,
    CASE WHEN regexp_matches(path, '(?i)%[0-9a-f]{2}|\s') THEN 'encoded characters' END, CASE WHEN length(path) > 75 THEN 'long' END,
    CASE WHEN length(path) - length(replace(path, '/', '')) > 3 THEN 'deep' END,
    CASE WHEN regexp_matches(path, '[0-9]{5,}|[a-f0-9]{12,}') THEN 'IDs/hashes instead of words' END,
    CASE WHEN contains(url, '?') THEN 'query parameters' END], lambda x: x IS NOT NULL)) AS problem FROM urls
), every AS (
  SELECT url, severity, category, issue, current_value, '' AS element, '02_page_seo' AS report FROM issues
  UNION ALL SELECT url, 'Optimization', 'URL', 'URL not SEO-friendly', problem, '', 'url_report' FROM u
  UNION ALL SELECT url, severity, category, upper(issue), current_value, '', '20_seo_report' FROM issues WHERE category = 'Title'
)"""


def every_issue(spark, sf_dir):
    """Issues of three reports: the page rules, the url rules, and the title rules as the all-in-one report spells them.

    One pass over the pages for all of them; queries that need the issues several times write them once."""
    rows = counted_facts(spark, sf_dir).withColumn("path", U.path(F.col("url")))
    url = [Rule("Optimization", "URL", "URL not SEO-friendly", c, F.lit(p), report="url_report") for p, c in url_problems(F.col("path"), F.col("url"))]
    again = [replace(r, issue=r.issue.upper(), report="20_seo_report") for r in title_pack()]
    return evaluate(rows, [*title_pack(), *h1_pack(), *url, *again], report="02_page_seo")


@query(BOTH_SQL + r""", by_host AS (SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS url, issue, current_value, element FROM every),
n AS (SELECT *, row_number() OVER (PARTITION BY url, issue ORDER BY current_value, element) AS nth, count(*) OVER (PARTITION BY url, issue) AS n FROM by_host)
SELECT url, issue, count(*) FILTER (nth <= 3)::BIGINT AS rows_kept, max(CASE WHEN nth = 4 THEN (n - 3)::VARCHAR || ' more occurrences not listed' END) AS overflow FROM n GROUP BY 1, 2""")
def issue_cap(spark, sf_dir):
    """The cap of rows for each key and check, here of three for each host, with its overflow row."""
    rows = cut_lineage(every_issue(spark, sf_dir).withColumn("url", F.regexp_extract("url", "^[a-z]+://([^/]*)", 1)))
    capped = scoring.cap_issues(rows, 3)
    more = F.col("current_value").endswith(" more occurrences not listed")
    return capped.groupBy("url", "issue").agg(F.count_if(~more).alias("rows_kept"), F.max(F.when(more, F.col("current_value"))).alias("overflow"))


@query(BOTH_SQL + " SELECT severity, category, issue, count(DISTINCT url)::BIGINT AS pages, count(*)::BIGINT AS occurrences FROM every GROUP BY 1, 2, 3")
def issue_types(spark, sf_dir):
    return scoring.issue_types(every_issue(spark, sf_dir))


@query(BOTH_SQL + r""" SELECT p.url, count(*) FILTER (severity = 'Critical')::BIGINT AS critical, count(*) FILTER (severity = 'Important')::BIGINT AS important,
count(*) FILTER (severity = 'Optimization')::BIGINT AS optimization, count(e.url)::BIGINT AS total FROM (SELECT DISTINCT url FROM pages) p LEFT JOIN every e ON e.url = p.url GROUP BY 1""")
def url_summary(spark, sf_dir):
    return scoring.url_summary(table(spark, sf_dir, "pages"), every_issue(spark, sf_dir))


@query(BOTH_SQL + r""" SELECT report || '-' || left(md5(report || url || '|' || issue || '|' || current_value || '|' || element), 10) AS id, url, issue FROM every""")
def issue_ids(spark, sf_dir):
    rows = every_issue(spark, sf_dir)
    return rows.select(scoring.issue_id(*[F.col(c) for c in ("report", "url", "issue", "current_value", "element")]).alias("id"), "url", "issue")


@query(BOTH_SQL + r""", r AS (SELECT *, CASE severity WHEN 'Critical' THEN 0 WHEN 'Important' THEN 1 WHEN 'Optimization' THEN 2 ELSE 3 END AS rk FROM every)
SELECT url, min_by(issue, (rk, severity, issue)) AS issue, min_by(severity, (rk, severity, issue)) AS severity, current_value, array_to_string(list_sort(list(DISTINCT report)), ', ') AS reported_by
FROM r GROUP BY url, lower(issue), current_value, element""")
def merged_issues(spark, sf_dir):
    return scoring.merge_reports(every_issue(spark, sf_dir)).select("url", "issue", "severity", "current_value", "reported_by")


SCORES_SQL = BOTH_SQL + r""", w AS (
  SELECT report, url, sum(CASE severity WHEN 'Critical' THEN 25 WHEN 'Important' THEN 8 WHEN 'Optimization' THEN 2 ELSE 0 END) AS d
  FROM (SELECT DISTINCT report, url, severity, issue FROM every) GROUP BY 1, 2
), rep AS (SELECT DISTINCT report FROM every), s AS (
  SELECT rep.report, round(avg(greatest(0, 100 - coalesce(d, 0))), 1) AS score FROM rep, (SELECT DISTINCT url FROM pages) p LEFT JOIN w ON w.report = rep.report AND w.url = p.url GROUP BY 1
), cats AS (SELECT * FROM (VALUES """ + ", ".join(f"('{c}', {w}, '{k}')" for c, w, keys in CATEGORIES for k in keys) + r""") AS t(category, weight, report)),
cs AS (SELECT category, weight, round(avg(score), 1)::DOUBLE AS score FROM cats LEFT JOIN s USING (report) GROUP BY 1, 2)"""


def report_scores(spark, sf_dir):
    """(report, score) of the three reports: mean page scores, as none of their issues is site-level."""
    total = table(spark, sf_dir, "pages").agg(F.count_distinct("url").alias("total"))
    issues = every_issue(spark, sf_dir).select("report", "url", "severity", "issue").distinct()
    taken = issues.groupBy("report", "url").agg(F.sum(scoring.page_weight(F.col("severity"))).alias("d"))
    sums = taken.groupBy("report").agg(F.sum(F.greatest(F.lit(0), 100 - F.col("d"))).alias("left"), F.count("*").alias("n"))
    # pages without an issue have all 100 points
    score = (F.col("left") + 100 * (F.col("total") - F.col("n"))) / F.col("total")
    return sums.join(F.broadcast(total)).select("report", F.round(score, 1).alias("score"))


def _categories(spark):
    return scoring.literal(spark, [(c, w, k) for c, w, keys in CATEGORIES for k in keys], "category string, weight int, report string")


@query(SCORES_SQL + r""" SELECT category, weight, score, CASE WHEN score IS NULL THEN 'Not measured' WHEN score >= 90 THEN 'Excellent' WHEN score >= 80 THEN 'Good' WHEN score >= 70 THEN 'Needs Improvement' WHEN score >= 50 THEN 'Poor' ELSE 'Critical' END AS grade FROM cs""")
def category_scores(spark, sf_dir):
    return scoring.category_scores(_categories(spark), report_scores(spark, sf_dir))


@query(SCORES_SQL + r""", o AS (SELECT round(sum(score * weight) / sum(weight), 1)::DOUBLE AS overall FROM cs WHERE score IS NOT NULL)
SELECT overall, CASE WHEN overall >= 90 THEN 'Excellent' WHEN overall >= 80 THEN 'Good' WHEN overall >= 70 THEN 'Needs Improvement' WHEN overall >= 50 THEN 'Poor' ELSE 'Critical' END AS grade FROM o""")
def health_score(spark, sf_dir):
    return scoring.health_score(category_scores(spark, sf_dir))


def _values(rows):
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, list) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


CHECK_SQL = BOTH_SQL + f""", checks AS (SELECT * FROM (VALUES {_values(CHECKS)}) AS t(id, kind, fails)),
sources AS (SELECT * FROM (VALUES {_values(SOURCES)}) AS t(id, report, issue_re, category_re, exclude_re)),
human AS (SELECT * FROM (VALUES {_values(HUMAN)}) AS t(id, said, server)),""" + r"""
hit AS (
  SELECT DISTINCT s.id, e.url, e.issue, e.current_value, e.element, e.severity FROM every e JOIN sources s ON s.report = e.report
  WHERE (issue_re IS NULL OR regexp_matches(lower(issue), issue_re)) AND (category_re IS NULL OR regexp_matches(lower(category), category_re))
    AND (exclude_re IS NULL OR NOT regexp_matches(lower(issue), exclude_re))
), f AS (
  SELECT id, count(*) AS n, min(CASE severity WHEN 'Critical' THEN 1 WHEN 'Important' THEN 2 WHEN 'Optimization' THEN 3 END) AS worst, count(DISTINCT url) AS pages FROM hit GROUP BY id
), ran AS (SELECT id, count(*) AS n_ran FROM sources WHERE report IN (SELECT report FROM every) GROUP BY id),
res AS (
  SELECT c.id, CASE WHEN kind = 'HUMAN' THEN 'HUMAN' WHEN coalesce(n_ran, 0) = 0 THEN 'SKIP'
    WHEN n > 0 THEN CASE WHEN list_contains(fails, ['Critical', 'Important', 'Optimization'][worst]) THEN 'FAIL' ELSE 'WARN' END ELSE 'PASS' END AS auto_status,
    coalesce(n, 0)::BIGINT AS n_matched, coalesce(pages, 0)::BIGINT AS pages
  FROM checks c LEFT JOIN f USING (id) LEFT JOIN ran USING (id)
), results AS (SELECT id, auto_status, coalesce(upper(said), auto_status) AS status, n_matched, pages FROM res LEFT JOIN human USING (id))"""


@query(CHECK_SQL + " SELECT * FROM results")
def checklist(spark, sf_dir):
    issues = cut_lineage(every_issue(spark, sf_dir))
    checks = scoring.literal(spark, CHECKS, "id string, kind string, fails array<string>")
    sources = scoring.literal(spark, SOURCES, "id string, report string, issue_re string, category_re string, exclude_re string")
    human = scoring.literal(spark, HUMAN, "id string, status string, server string")
    return scoring.checklist(checks, sources, issues, issues.select("report").distinct(), human)


@query(CHECK_SQL + r""", c AS (SELECT count(*) FILTER (status = 'FAIL')::BIGINT AS fail, count(*) FILTER (status = 'WARN')::BIGINT AS warn, count(*) FILTER (status = 'SKIP')::BIGINT AS skip,
count(*) FILTER (status = 'HUMAN')::BIGINT AS human, count(*) FILTER (status = 'PASS')::BIGINT AS pass FROM results)
SELECT *, CASE WHEN fail > 0 THEN 'NEEDS FIXES' WHEN warn + skip + human > 0 THEN 'REVIEW' ELSE 'READY' END AS verdict FROM c""")
def verdict(spark, sf_dir):
    return scoring.verdict(checklist(spark, sf_dir))


#: The first rules of the guide that name an issue, in order.
GUIDE = [(1, "title (missing|too short|too long)", "title length"), (2, "duplicate title", "title unique"), (3, r"\bh1\b", "one h1"), (4, "url not seo", "readable url"), (5, "title", "title")]
FALLBACKS = [("headings", "see the heading"), ("title", "see the title")]


@query(BOTH_SQL + f""", g AS (SELECT * FROM (VALUES {", ".join(f"({o}, '{p}', '{r}')" for o, p, r in GUIDE)}) AS t(ord, pattern, rule)), f AS (SELECT * FROM (VALUES {", ".join(f"('{c}', '{r}')" for c, r in FALLBACKS)}) AS t(category, rule)),
n AS (SELECT DISTINCT category, issue FROM every), """ + r"""h AS (SELECT n.issue, min_by(rule, ord) AS rule FROM n JOIN g ON regexp_matches(lower(n.issue), g.pattern) GROUP BY 1)
SELECT n.category, n.issue, coalesce(h.rule, f.rule) AS rule FROM n LEFT JOIN h USING (issue) LEFT JOIN f ON f.category = lower(n.category)""")
def guide_lookup(spark, sf_dir):
    """The advice of the first rule that names each issue, else that of its category."""
    rules = scoring.literal(spark, GUIDE, "ord int, pattern string, rule string")
    other = scoring.literal(spark, FALLBACKS, "category string, rule string")
    return guide.guided(every_issue(spark, sf_dir).select("category", "issue").distinct(), "issue", rules, other, "category").select("category", "issue", "rule")


@query(r"""WITH r AS (SELECT row_number() OVER (ORDER BY t DESC) AS ord, t, CASE WHEN length(t) % 3 = 0 THEN '^' || lower(t) ELSE regexp_replace(lower(t), ' ', '.*', 'g') END AS pattern FROM (SELECT DISTINCT p_name || CASE WHEN p_size > 25 THEN '' ELSE ' ' || p_type END AS t FROM part)),
x AS (SELECT p_partkey, p_name || ' / ' || p_type AS text FROM part), h AS (SELECT p_partkey, min_by(t, ord) AS rule FROM x JOIN r ON regexp_matches(lower(text), pattern) GROUP BY 1)
SELECT p_partkey, rule FROM part LEFT JOIN h USING (p_partkey)""")
def pattern_guide(spark, sf_dir):
    """The first of many patterns (laid over the names and types of parts) that occurs in each part's name and type."""
    from pyspark.sql import Window

    part = table(spark, sf_dir, "part")
    kinds = part.select(F.concat("p_name", F.when(F.col("p_size") > 25, "").otherwise(F.concat(F.lit(" "), "p_type"))).alias("t")).distinct()
    low = F.lower("t")
    pattern = F.when(F.length("t") % 3 == 0, F.concat(F.lit("^"), low)).otherwise(F.regexp_replace(low, " ", ".*"))
    # names and types are words of short lists: a small table, whatever the number of parts
    rules = kinds.select(F.row_number().over(Window.orderBy(F.desc("t"))).alias("ord"), pattern.alias("pattern"), F.col("t").alias("rule"))
    rows = part.select("p_partkey", F.concat("p_name", F.lit(" / "), "p_type").alias("text"))
    return guide.guided(rows, "text", rules).select("p_partkey", "rule")


VENDOR_URL = [("cdn.jsdelivr.net/x.js",), ("www.google.com/maps/embed",), ("js.stripe.com/v3",), ("static.hotjar.com/c",), ("nothing.example/x",)]


@query("WITH t AS (SELECT page_id, url, ['" + "', '".join(u for (u,) in VENDOR_URL) + "'][page_id % 5 + 1] AS src FROM pages) SELECT url, CASE " + " ".join(f"WHEN regexp_matches(lower(src), '{p}') THEN '{n}'" for p, n in VENDORS) + " ELSE 'Other' END AS vendor FROM t")
def vendor_class(spark, sf_dir):
    """Vendors of a resource laid over each page."""
    src = F.element_at(F.array(*[F.lit(u) for (u,) in VENDOR_URL]), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("url", vendor(src).alias("vendor"))


@query(BOTH_SQL + r""", n AS (SELECT *, row_number() OVER (PARTITION BY report ORDER BY CASE severity WHEN 'Critical' THEN 0 WHEN 'Important' THEN 1 WHEN 'Optimization' THEN 2 ELSE 3 END, url, issue, current_value) AS nth FROM every)
SELECT report, nth::INTEGER AS nth, url, issue, CASE WHEN length(current_value) <= 20 THEN current_value ELSE left(current_value, 17) || '...' END AS evidence FROM n WHERE nth <= 8""")
def evidence(spark, sf_dir):
    """The eight gravest rows of each report, values clipped."""
    from auditloom.operators.metrics import top_per_group
    from auditloom.operators.rules import rank

    rows = every_issue(spark, sf_dir)
    top = top_per_group(rows, "report", [rank(F.col("severity")), F.col("url"), F.col("issue"), F.col("current_value")], 8)
    return top.select("report", F.col("rn").alias("nth"), "url", "issue", T.clip(F.col("current_value"), 20).alias("evidence"))
