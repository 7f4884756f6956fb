"""The sitemap report on literal sitemaps, robots files and records."""

from pyspark.sql import functions as F

from auditloom.operators import sitemap_report as M
from auditloom.operators.rules import SITE_WIDE
from auditloom.sources.tables import robots_allowed, robots_rules

NAMESPACE = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
RECORD = "url string, status int, error string, redirect_to string, in_sitemap boolean, robots_blocked boolean, is_html boolean, noindex boolean, canonical string, content_type string, via string, found_on string, sources int"


def found(frame):
    return sorted((r.url, r.issue, r.current_value) for r in frame.collect())


def test_entries(spark):
    rows = [("https://a/X", "2024"), ("https://a/x", "2024-02-30"), ("https://a/x", "2024-02-30"), ("https://a/y", ""), ("https://a/z", "2030-01-01T00:00:00+02:00"), (None, "bad")]
    entries = spark.createDataFrame(rows, "loc string, lastmod string")
    assert found(M.entry_rules(entries, F.to_timestamp(F.lit("2029-12-31T21:59:59Z")))) == [
        ("https://a/x", "Duplicate URL in sitemap", "listed 2 times"), ("https://a/x", "Invalid <lastmod> date", "2024-02-30"), ("https://a/x", "Same URL with different letter case", "https://a/x"),
        ("https://a/y", "Missing <lastmod>", "(none)"), ("https://a/z", "<lastmod> in the future", "2030-01-01T00:00:00+02:00"),
    ]
    assert "future" not in str(found(M.entry_rules(entries, F.to_timestamp(F.lit("2029-12-31T22:00:00Z"))))) and M.entry_rules(entries.limit(0)).count() == 0


def test_sites(spark):
    rows = [("s1", "https://a.org/1"), ("s1", "https://a.org/2"), ("s1", "http://b.org/1"), ("s1", None), ("s2", "http://localhost:3000/"), ("s3", "https://ok.org/"), ("s3", "https://ok.org/x")]
    assert found(M.site_rules(spark.createDataFrame(rows, "sitemap string, loc string"))) == [
        ("s1", "Sitemap mixes hosts", "a.org, b.org"), ("s2", "Sitemap URLs are not HTTPS", "http://localhost:3000"), ("s2", "Sitemap URLs point to a local/development host", "http://localhost:3000"),
    ]
    many = spark.range(M.MOST_URLS + 1).select(F.lit("s").alias("sitemap"), F.concat(F.lit("https://a.org/"), F.col("id").cast("string")).alias("loc"))
    assert found(M.site_rules(many)) == [("s", "More than 50,000 URLs in one sitemap", "50001 URLs")] and M.site_rules(many.where("loc <> 'https://a.org/0'")).count() == 0


def test_files(spark):
    body = f"<urlset {NAMESPACE}><url><loc>https://a/</loc></url></urlset>"
    rows = [("ok", 200, "text/xml", body), ("html", 200, "text/html", body), ("none", 200, None, body), ("gone", 404, "text/xml", body), ("empty", 200, "text/xml", f"<urlset {NAMESPACE}/>"), ("bare", 200, "text/xml", "<urlset><url/></urlset>"), ("null", None, None, None)]
    assert found(M.file_rules(spark.createDataFrame(rows, "url string, status int, content_type string, body string"))) == [
        ("bare", "sitemap.xml has no sitemaps.org namespace", "<urlset>"), ("empty", "sitemap.xml missing or invalid", "no <url> entries"), ("gone", "sitemap.xml missing or invalid", "HTTP 404"),
        ("html", "sitemap.xml not served as XML", "text/html"), ("none", "sitemap.xml not served as XML", "(no Content-Type)"), ("null", "sitemap.xml missing or invalid", "HTTP "),
    ]


def test_robots(spark):
    rows = [
        ("a.org", 200, "User-agent: *\nDisallow: /\nSitemap: https://a.org/s.xml\nsitemap: https://b.org/s.xml"), ("b.org", 404, None), ("c.org", 200, "# nothing"), ("d.org", 200, "User-agent: *\nDisallow: /x\nSitemap: https://d.org/s.xml"), ("e.org", None, None),
    ]
    robots = spark.createDataFrame(rows, "host string, status int, body string")
    allowed = robots_allowed(robots.select("host", F.lit("/").alias("path")), robots_rules(robots.where("status = 200")))
    files = spark.createDataFrame([("https://a.org/s.xml", 500), ("https://d.org/s.xml", 200)], "url string, status int")
    got = sorted((r.element, r.issue, r.current_value) for r in M.robots_rules(robots, allowed, files).collect())
    assert got == [
        ("a.org", "Sitemap declared in robots.txt is unreachable", "https://a.org/s.xml"), ("a.org", "robots.txt blocks the homepage / whole site", "Disallow matches /"), ("a.org", "robots.txt sitemap on a different host", "https://b.org/s.xml"),
        ("b.org", "robots.txt missing", "HTTP 404"), ("c.org", "robots.txt has no Sitemap: line", "(none)"), ("c.org", "robots.txt has no User-agent group", ""), ("e.org", "robots.txt missing", "HTTP 0"),
    ]


def test_listed_urls_and_coverage(spark):
    S, html = "https://s.org/", ("text/html", "link", "https://s.org/", 1)
    rows = [
        (S + "1", 301, None, "/to", True, None, False, False, None, *html), (S + "2", 500, "late", None, True, True, False, False, None, *html), (S + "3", 200, None, None, True, False, True, True, S + "4", *html),
        (S + "4", 200, None, None, True, False, True, False, "/4/", *html), (S + "5", 200, None, None, True, False, True, False, "https://www.s.org/5", *html), (S + "6", 200, None, None, False, False, True, False, "", *html),
        (S + "7", 200, None, None, False, False, True, True, None, *html), (S + "8", 200, None, None, False, False, True, False, S + "6", *html), (S + "9", 404, "", None, False, False, True, False, None, *html),
        (S + "a", 0, "no answer", None, None, None, None, None, None, None, None, None, None), (S + "b", 302, None, S + "c", False, False, False, False, None, *html), (S + "c", 200, None, None, False, False, False, False, None, "image/png", "link", S, 1),
        (S + "d", 200, None, None, False, False, False, False, None, "image/png", "script", S, 1), (S + "e", 200, None, None, False, True, True, False, None, *html), (S + "f", None, None, None, False, False, False, False, None, *html), (None,) * 13,
    ]
    records = spark.createDataFrame(rows, RECORD)
    assert found(M.listed_url_rules(records)) == [
        (SITE_WIDE, "Sitemap host differs from the canonical host", "canonical host www.s.org, sitemap host s.org"), (S + "1", "Sitemap URL redirects", "HTTP 301 -> https://s.org/to"), (S + "2", "Sitemap URL blocked by robots.txt", "Disallowed for Googlebot"),
        (S + "2", "Sitemap URL is not 200", "HTTP 500 late"), (S + "3", "Sitemap URL canonicalises elsewhere", S + "4"), (S + "3", "Sitemap URL is noindex", "noindex"),
    ]
    assert sorted((r.url, r.severity, r.issue, r.current_value) for r in M.coverage_rules(records).collect()) == [
        (S + "2", "Optimization", "Internal URL blocked by robots.txt", "Disallowed"), (S + "6", "Important", "Live page missing from sitemap", "not in sitemap.xml"), (S + "9", "Important", "Broken internal URL", "HTTP 404"),
        (S + "a", "Critical", "Broken internal URL", "HTTP 0 no answer"), (S + "b", "Optimization", "Internal URL redirects", f"HTTP 302 -> {S}c"), (S + "c", "Optimization", "Internal link to a non-HTML page", "image/png"),
        (S + "e", "Optimization", "Internal URL blocked by robots.txt", "Disallowed"),
    ]
    assert M.coverage_rules(records.limit(0)).count() == 0
