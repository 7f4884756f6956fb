"""Resources, third parties, files and facts of a run, on literal tables."""

import pytest
from pyspark.sql import functions as F

from auditloom.functions import classify as C
from auditloom.operators import resources as R
from auditloom.operators import run_facts as N
from auditloom.sources import tables as S
from auditloom.sources.elements import html_elements


def test_bytes_by_kind(spark):
    rows = [("p", "a.js?x", "script", 0, 7), ("p", "https://h/a.js", "other", 5, 9), ("p", "a.css?v", "link", None, 4), ("p", "/_next/image?u=a", "x", 3, 0), ("p", "F.WOFF2", None, 2, None), ("p", "api", None, None, None), ("q", "x.svg", "fetch", 1, 1)]
    got = {r.page: tuple(r)[1:] for r in R.bytes_by_kind(spark.createDataFrame(rows, "page string, url string, type string, size long, body long")).collect()}
    assert got == {"p": (12, 4, 3, 2, 0, 21), "q": (0, 0, 1, 0, 0, 1)}


def test_third_parties(spark):
    uses = [("https://s/1", "https://A.com/x.js", "Script"), ("https://s/1", "https://A.com/x.js", "Script"), ("https://s/2", "https://A.com/y", "Link"), ("https://s/2", "http://b.net/f", "Iframe"), ("https://s/3", "https://unprobed/", "Link")]
    probes = [("https://A.com/x.js", "Error", 500, None, 0, None), ("https://A.com/y", "Redirect", 200, "z", 2, None), ("http://b.net/f", "Timeout", 0, None, 0, "slow"), ("http://b.net/f", "Error", 0, None, 0, "")]
    uses = spark.createDataFrame(uses, "page string, url string, kind string")
    probes = spark.createDataFrame(probes, "url string, status string, code int, final string, hops int, error string")
    got = {r.host: (r.uses, r.pages, r.failing, r.first_pages, r.first_urls) for r in R.third_party_domains(uses, probes, 1).collect()}
    assert got == {"a.com": (3, 2, 2, ["https://s/1"], ["https://A.com/x.js"]), "b.net": (1, 1, 1, ["https://s/2"], ["http://b.net/f"])}
    issues = sorted((r.url, r.severity, r.issue, r.current_value) for r in R.third_party_rules(uses, probes).distinct().collect())
    assert issues == [
        ("https://s/1", "Critical", "Third-party URL broken", "HTTP 500"), ("https://s/2", "Important", "Third-party URL over http:// (insecure)", "http://b.net/f"),
        ("https://s/2", "Important", "Third-party URL timeout", "slow"), ("https://s/2", "Optimization", "Third-party URL redirects", "2 redirect(s)"),
    ]
    assert R.third_party_domains(uses.limit(0), probes).count() == R.third_party_rules(uses, probes.limit(0)).count() == 0


def test_images_of_pages(spark):
    html = '<img src="a.png" alt="A"><img src="b.PNG?x"><img data-src="c.webp" alt=" "><img alt="" aria-hidden="true"><img alt="" role="none">'
    pages = spark.createDataFrame([("u", html), ("v", "<p>none"), ("w", '<img alt="" src="x.gif">')], "url string, html string")
    elements = html_elements(pages.withColumns({"page_id": F.lit(1)}))
    assert {r.url: tuple(r)[1:] for r in R.image_alt_summary(elements).collect()} == {"u": (5, 3, 1, 1, "Error"), "v": (0, 0, 0, 0, "Correct"), "w": (1, 0, 0, 1, "Warning")}
    assert {r.format: r.images for r in R.image_endings(elements).collect()} == {"png": 2, "webp": 1, "gif": 1, "unknown": 2}


def test_fonts(spark):
    css = "@font-face{font-family:'Inter';src:url(a.woff2) format('woff2'),url(\"b.TTF?x\");}\n@font-face { font-family: Loc; src: local(Arial) } @font-face{font-family:B;src:url(b.woff);font-display:swap}"
    faces = R.font_faces(spark.createDataFrame([("s.css", css), ("none", None), ("e", "")], "url string, body string"))
    assert sorted((r.family, r.formats, r.display, r.files) for r in faces.collect()) == [("B", ["woff"], "swap", 1), ("Inter", ["ttf", "woff2"], "", 2)]
    assert sorted((r.url, r.issue[:9], r.current_value) for r in R.font_rules(faces).collect()) == [("(site-wide)", "Font file", "Inter: ttf"), ("(site-wide)", "font-disp", "Inter")]


def test_manifests(spark):
    full = '{"name":"N","short_name":"S","start_url":"/","display":"standalone","theme_color":"#fff","background_color":"","icons":[{"sizes":"192x192"},{"src":"x"},{"sizes":"any"}]}'
    rows = [("full", 200, full), ("list", 200, "[1]"), ("bad", 404, "<html>"), ("null", 0, None)]
    got = sorted((r.element, r.issue, r.current_value) for r in R.manifest_rules(spark.createDataFrame(rows, "url string, status int, body string")).collect())
    bad = "Manifest is missing or invalid JSON"
    assert got == [("bad", bad, "HTTP 404"), ("full", "Manifest has no 512x512 icon", ""), ("full", "Manifest missing background_color", ""), ("list", bad, "HTTP 200"), ("null", bad, "HTTP 0")]


def test_feeds(spark):
    rss = "<?xml version='1.0'?><rss><channel><link>http://localhost:3000/</link><item><link>https://a/1</link></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><link href="https://a/"/></feed>'
    rows = [("rss", 200, rss, True), ("atom", 200, atom, False), ("gone", 404, None, True), ("guess", 404, "", False), ("page", 200, "<html><item></html>", False)]
    feeds = spark.createDataFrame(rows, "url string, status int, body string, linked boolean")
    facts = {r.url: (r.is_feed, r.entries, r.links) for r in R.feed_facts(feeds).collect()}
    assert facts["rss"] == (True, 1, ["http://localhost:3000/", "https://a/1"]) and facts["atom"] == (True, 0, ["https://a/"]) and not facts["page"][0]
    got = sorted((r.element, r.issue, r.current_value) for r in R.feed_rules(feeds).collect())
    assert got == [("atom", "RSS / Atom feed has no entries", "0 items"), ("gone", "Linked RSS / Atom feed is broken", "HTTP 404"), ("rss", "Feed links point to a development host", "http://localhost:3000/")]
    assert R.feed_rules(feeds, public=False).count() == 2


def test_files_and_messages(spark):
    files = spark.createDataFrame([(f"a/__pycache__/{i}.pyc",) for i in range(7)] + [("web/.next/x",), ("src/a.py",), ("coverage/r",), (None,)], "path string")
    got = {r.kind: (r.files, r.examples) for r in R.file_groups(files).collect()}
    assert got == {"__pycache__": (7, ", ".join(f"a/__pycache__/{i}.pyc" for i in range(5))), ".next": (1, "web/.next/x"), "build output": (1, "coverage/r")}
    messages = spark.createDataFrame([("file:/private/a%20b.html", "error", None), ("file:///c.html", "info", "warning"), ("file:///d.html", "info", None), (None, "error", None)], "url string, type string, subType string")
    known = spark.createDataFrame([("a b.html", "https://s/a"), ("z.html", "https://s/z")], "name string, loc string")
    assert sorted((r.url or "", r.loc or "") for r in R.message_pages(messages, known).collect()) == [("", ""), ("file:///c.html", ""), ("file:/private/a%20b.html", "https://s/a")]


def test_pages_of_a_run(spark):
    records = [("https://s/a", 200, True, None, "https://s/x", 3, None), ("https://s/b", 200, True, True, "https://s/x", 9, None), ("https://s/c", 200, True, False, "https://s/c/", 1, None), ("https://s/d", 404, True, True, None, 0, ""), ("https://s/e", 0, False, True, None, 2, "refused"), ("https://s/f", None, None, None, None, 4, None)]
    records = spark.createDataFrame(records, "url string, status int, is_html boolean, in_sitemap boolean, canonical string, ord int, error string")
    assert [r.url for r in N.site_pages(records).collect()] == ["https://s/b", "https://s/c"]
    assert [tuple(r) for r in N.answers(records, 2).collect()] == [("200", 3), ("404", 1)] and {r.answer for r in N.answers(records).collect()} == {"200", "404", "refused", "?"}
    edges = lambda *rows: spark.createDataFrame(list(rows), "source string, target string")
    assert [r.url for r in N.script_only(edges(("a", "b"), ("c", "c")), edges(("a", "b"), ("a", "c"), ("b", "c"))).collect()] == ["c"]
    assert N.all_edges(edges(("https://s/a", "https://s/b/")), edges(("https://s/a/", "https://s/b"), ("x", "y"))).count() == 2
    url = lambda *rows: spark.createDataFrame([(r,) for r in rows], "url string")
    assert sorted(r.url for r in N.seeds(url("https://s/a/", None), url("https://s/a", "https://s/b")).collect()) == ["https://s/a/", "https://s/b"]
    issues = spark.createDataFrame([("a", "Critical"), ("a", "Important"), ("b", "Optimization")], "url string, severity string")
    assert tuple(N.clean_pages(url("a", "b", "c"), issues).first()) == (3, 2) and tuple(N.clean_pages(url(), issues).first()) == (0, 0)
    assert [r.key for r in N.missing_reports(spark.createDataFrame([("02",), ("03",)], "key string"), spark.createDataFrame([("02",)], "key string")).collect()] == ["03"]


def test_share_image_and_scores(spark):
    images = lambda *v: N.dominant_image(spark.createDataFrame([(x,) for x in v], "og_image string")).collect()
    assert [(r.current_value, r.element) for r in images("i", "i", "i", "i", None, "")] == [("4 of 6 pages", "i")]
    assert not images("i", "i", "i", None, "", "j") and not images("i", "i") and not images()
    ratings = spark.createDataFrame([("Good", "Good", "n/a"), ("Good", "Poor", "Good"), ("Good", "Good", "Poor")], "lcp string, cls string, inp string")
    assert tuple(N.passing(ratings).first()) == (3, 1)
    scores = spark.createDataFrame([(90, 50, None), (95, 50, None), (92, None, None)], "seo int, perf int, none int")
    assert {r.category: r.average for r in N.category_averages(scores, ("seo", "perf", "none")).collect()} == {"seo": 92.3, "perf": 50.0, "Overall": 71.2}


def test_failing_items(spark):
    details = '{"items":[{"node":{"snippet":"<a>"}},{"url":"u"},{"source":{"url":"w"}},{"description":{"text":"t"}},{"type":"node","nodeLabel":"L"},{"x":1,"subItems":{"items":[{"url":"sub"}]}},{"url":"u"},{}]}'
    rows = spark.createDataFrame([(1, details), (2, None), (3, "{}"), (4, "nonsense")], "id int, d string")
    got = {r.id: (r.f.labels, r.f.total) for r in rows.select("id", N.failing_items(F.col("d")).alias("f")).collect()}
    assert got == {1: (["<a>", "u", "w", "t", "L"], 8), 2: ([], 0), 3: ([], 0), 4: ([], 0)}
    assert rows.where("id = 1").select(N.failing_items(F.col("d"), 9).labels).first()[0] == ["<a>", "u", "w", "t", "L", "sub"]


def test_reports_of_a_run(spark):
    reports = spark.createDataFrame([("02", 80, "x"), ("03", 90, "y"), ("04", 0, "x"), ("28_repo", 1, None)], "key string, pages_checked int, server string")
    assert [(r.key, r.note) for r in N.partial_coverage(reports, 100).collect()] == [("02", "02: 80 of 100 pages")]
    assert tuple(N.servers(reports).first()) == ("x", 3, True) and N.servers(reports.limit(0)).count() == 0
    results = [("B", "Title", "2 bad", "WARN", "SEO", ["e" * 120, "f"]), ("A", "Name", "none", "FAIL", "Dev", []), ("C", "X", "r", "FAIL", "SEO", None), ("D", "X", "r", "PASS", "SEO", None)]
    notes = N.owner_notes(spark.createDataFrame(results, "id string, title string, result string, status string, owner string, evidence array<string>"), ("SEO",))
    assert [r.note for r in notes.collect()] == ["- C X: r", "- B Title: 2 bad e.g. " + "e" * 100]
    order = spark.createDataFrame([(s,) for s in ("PASS", "?", "FAIL", "HUMAN", "WARN", "SKIP")], "s string").orderBy(N.status_rank(F.col("s")))
    assert [r.s for r in order.collect()] == ["FAIL", "WARN", "SKIP", "HUMAN", "PASS", "?"]
    summary = spark.createDataFrame([("(site-wide)", 9, 9), ("b", 1, 2), ("a", 1, 2), ("c", 1, 3)], "url string, critical int, important int")
    assert [r.url for r in summary.orderBy(*N.master_order()).collect()] == ["c", "a", "b", "(site-wide)"]


def test_names_and_shared_blocks(spark):
    names = spark.createDataFrame([("title", "Acme Ltd.", 1), ("org", "ACME", 1), ("title", "Akme", 1), ("title", "Akme", 2), ("h1", "Acme Tools, Inc", 1), ("h1", " LLC ", 3), ("h1", None, 3)], "source string, name string, page int")
    assert [tuple(r) for r in N.name_variants(names, "Acme Limited").collect()] == [("title", "Akme", 2)] and N.name_variants(names, "").count() == 0
    places = spark.createDataFrame([("t", f"p{i}", 9 - i) for i in range(4)] + [("u", "p1", 1), ("u", "p1", 5), ("u", "p2", 2)], "text string, url string, ord int")
    got = sorted((r.text, r.url) for r in N.shared_blocks(spark.createDataFrame([("t", "i"), ("u", "j"), ("v", "k")], "text string, issue string"), places, 3).collect())
    assert got == [("t", "p3"), ("u", "p1"), ("u", "p2")]


@pytest.mark.parametrize("metric, value, shown", [("cls", 0.1234, "0.123"), ("lcp", 2500.0, "2.50 s"), ("inp", 180.4, "180 ms"), ("lcp", None, None)])
def test_vitals_shown(spark, metric, value, shown):
    row = spark.createDataFrame([(metric, value)], "m string, v double").select(C.vitals_shown(F.col("m"), F.col("v"))).first()
    assert row[0] == shown


def test_off_ratio(spark):
    rows = spark.createDataFrame([(1200, 630), (599, 314), (1200, 1200), (1200, 0), (2400, 1260)], "w int, h int").select(C.off_ratio(F.col("w"), F.col("h")))
    assert [r[0] for r in rows.collect()] == [False, True, True, True, False]


def test_sitemap_index(spark):
    index = '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc> https://s/1.xml </loc></sitemap><sitemap><loc>https://s/2.xml</loc></sitemap><sitemap><loc>https://s/3.xml</loc></sitemap><sitemap></sitemap></sitemapindex>'
    one = '<s:urlset xmlns:s="http://www.sitemaps.org/schemas/sitemap/0.9"><s:url><s:loc>https://s/a</s:loc></s:url><s:url><s:loc>https://s/b</s:loc><s:lastmod>2024</s:lastmod></s:url></s:urlset>'
    files = spark.createDataFrame([("https://s/sitemap.xml", 200, index), ("https://s/1.xml", 200, one), ("https://s/2.xml", 200, "<urlset></urlset>"), ("x", 404, None)], "url string, status int, body string")
    assert sorted((r.loc, r.status, r.entries, r.problem) for r in S.sitemap_children(files).collect()) == [("https://s/1.xml", 200, 2, ""), ("https://s/2.xml", 200, 0, "no <url> entries"), ("https://s/3.xml", 0, 0, "HTTP 0")]
    assert sorted((r.loc, r.lastmod) for r in S.sitemap_entries(files, "body").collect()) == [("https://s/a", None), ("https://s/b", "2024")]
    assert [r.url for r in S.without_namespace(files).collect()] == ["https://s/2.xml"]
