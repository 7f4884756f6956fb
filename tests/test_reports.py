"""Rule packs of the page reports, against literal pages with the problems that each rule names."""

import pytest
from pyspark.sql import functions as F

from auditloom.operators import report_rules as R
from auditloom.operators.element_rules import COLUMNS
from auditloom.plans.content import FILLER, PLACEHOLDER
from auditloom.sources.elements import html_elements

GOOD = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Careful widgets for patient gardeners</title>
<meta name="description" content="Careful widgets that patient gardeners use through all seasons of the year, explained in detail."><meta name="viewport" content="width=device-width">
<link rel="canonical" href="https://a.org/good-widgets"><meta property="og:site_name" content="A"></head><body><header></header><nav><a href="#main">Skip</a></nav>
<main id="main"><h1>Careful good widgets</h1><h2>Why</h2><p>text</p><a href="/x">one thing</a><a href="/y">two thing</a><a href="/z">three thing</a></main><footer></footer></body></html>"""
BAD = """<html><head><title>Shop</title><title>Two</title><meta name="Description" content="short"><meta name="description" content="again"><meta name="keywords" content="k">
<meta name="robots" content="NOINDEX, nofollow"><meta name="googlebot" content="none"><link rel="canonical" href="/else"><link rel="canonical" href="/more">
<meta property="og:title" content="Shop!"><meta property="og:url" content="/rel"><meta name="twitter:card" content="summary">
<link rel="alternate" hreflang="en" href="https://a.org/good-widgets"><link rel="alternate" hreflang="EN" href="https://a.org/good-widgets"><link rel="alternate" hreflang="zz" href="/zz"><link rel="alternate" hreflang="de-UK" href="https://a.org/de"></head>
<body><link rel="canonical" href="/x"><title>late</title><h1>Shop</h1><h1>Again</h1><center>x</center><div id="d"></div><p id="d"><a href="/q"><a href="/r">in</a></a></p>
<a>no href</a><a href="javascript:void(0)">js</a><a href="#">hash</a><a href="#nope">gone</a><a href="#d">there</a><a href="mailto:x@y.z">m</a><a name="top"></a><a href="/i"><img src="i.png" alt="Click here"></a><a href="/k"></a>
<a href="/n" rel="nofollow">Read more »</a><a href="https://b.org/" target="_blank">ext</a><a href="/own" aria-label="Own">x</a><button><a href="/b">b</a></button><button></button><p><div classname="z" onclick="{go}">d</div></p>
<img src="My_Photo.PNG"><img src="logo.png" alt="logo" width="1" height="2"><img src="c.jpg" alt="a b a c a" loading="lazy"><img src="20240101.jpg" alt="" role="presentation" width="5" height="5" srcset="s">
<div role="nonsense" aria-foo="1" tabindex="3"></div><button aria-hidden="true">h</button><iframe src="f"></iframe><video src="v"></video><form><input name="e"></form><h2>FAQ</h2>
<script type="application/ld+json">{"@context":"https://schema.org","@type":"Service","description":"x"}</script><script type="application/ld+json">{"@type":"WebSite","@id":"#w","name":"n"}</script>
<script type="application/ld+json">{"@graph":[{"@type":"WebSite","@id":"#w","name":"n","url":"u"},{"@id":"#r"}]}</script><script type="application/ld+json">{bad</script></body></html>"""
PAGES = [("https://a.org/good-widgets", GOOD), ("https://a.org/Bad_page/12345/x?q=1", BAD), ("https://a.org/none/", ""), ("https://a.org/blog/post", GOOD.replace("<p>text</p>", "<p>Lorem ipsum. In conclusion we delve into a tapestry.</p>")), ("https://a.org/null", None)]


@pytest.fixture(scope="module")
def tables(spark):
    pages = spark.createDataFrame(PAGES, "url string, html string")
    elements = html_elements(pages).cache()
    return elements, R.page_facts(pages, elements).cache()


def issues(frame, page):
    assert frame.columns == list(COLUMNS)
    out = {}
    for r in frame.collect():
        if r.url == PAGES[page][0]:
            out.setdefault(r.issue, []).append(r.current_value)
    return out


def test_page_seo(tables):
    elements, facts = tables
    found = R.page_seo_rules(facts, elements)
    assert issues(found, 0) == {}
    bad = issues(found, 1)
    assert set(bad) == {
        "Title too short", "Multiple <title> tags", "Description too short", "Multiple meta descriptions", "Meta keywords present (ignored by Google)", "H1 too short to be meaningful", "H1 identical to title",
        "Multiple H1", "Description doesn't mention the title topic", "URL not SEO-friendly",
    }
    assert bad["Title too short"] == ["4 chars: Shop"] and len(bad["URL not SEO-friendly"]) == 4 and bad["Multiple H1"] == ["2"]
    assert {"Title missing", "Meta description missing", "Missing H1", "No H2 sub-headings"} == set(issues(found, 2)) == set(issues(found, 4))


def test_duplicates(tables):
    found = R.duplicate_rules(tables[1])
    assert set(issues(found, 0)) == set(issues(found, 3)) == {"Duplicate title", "Duplicate description"} and issues(found, 1) == {}


def test_technical(tables):
    elements, facts = tables
    found = R.technical_rules(facts, elements)
    assert issues(found, 0) == {}
    assert set(issues(found, 1)) == {
        "Duplicate canonical tags", "Relative canonical URL", "Canonical is not self-referencing", "Canonical tag inside <body> (ignored)", "noindex via meta robots", "nofollow via meta robots",
        "'none' (noindex, nofollow) via meta googlebot", "Uppercase letters in URL", "Underscores/spaces in URL (use hyphens)", "Sitemap URL has parameters", "Missing <!DOCTYPE html>", "Missing <meta charset>",
        "Missing viewport meta", "Multiple <title> tags", "<title> inside <body>", "Duplicate IDs", "Empty links (no text / name)", "Empty buttons (no text / name)", "Deprecated <center> tag",
        "Link nested inside a link (invalid)", "Interactive element nested inside <button> (invalid)", "Block element inside <p> (browser rewrites the DOM)", "Invalid attribute in HTML (JSX attribute leaked)", "Multiple meta descriptions",
    } - {"Multiple meta descriptions"} | ({"Multiple meta descriptions"} & set(issues(found, 1)))
    assert {"Missing canonical", "Missing <html>", "Missing <head>", "Missing <body>", "Trailing slash in sitemap URL (inconsistent with others)"} < set(issues(found, 2))
    assert issues(found, 3)["Canonical is not self-referencing"] == ["https://a.org/good-widgets"]


def test_links(tables):
    elements, facts = tables
    found = R.link_rules(facts, elements)
    assert issues(found, 0) == {}
    bad = issues(found, 1)
    assert {k: len(v) for k, v in bad.items()} == {
        "Empty link (no href)": 1, "javascript: link": 1, 'Placeholder link (href="#")': 1, "In-page anchor points to a missing id": 1, "Link without text or accessible name": 1, "Non-descriptive anchor text": 2,
        "nofollow on an internal link": 1, "target=_blank without rel=noopener": 1, "Nested page without breadcrumbs": 1,
    }
    assert sorted(bad["Non-descriptive anchor text"]) == ["Click here", "Read more »"]
    assert set(issues(found, 2)) == {"No internal links on page"}
    kinds = {r.href: (r.kind, r.label) for r in R.labelled_links(elements).collect() if r.url == PAGES[1][0]}
    assert kinds["/i"] == ("internal", "Click here") and kinds["mailto:x@y.z"][0] == "other" and kinds["https://b.org/"][0] == "external" and kinds[""] == ("empty", "no href")


def test_social(tables):
    found = R.social_meta_rules(tables[1])
    bad = issues(found, 1)
    assert {"twitter:card is not summary_large_image", "og:url is not absolute", "Missing og:image", "Missing twitter:title"} < set(bad) and "Missing og:title" not in bad
    assert len(issues(found, 2)) == len(R.OPEN_GRAPH) + len(R.TWITTER)


def test_hreflang(tables):
    elements, facts = tables
    found = R.hreflang_rules(facts, R.hreflang_alternates(elements))
    bad = {k: sorted(v) for k, v in issues(found, 1).items()}
    assert bad["Duplicate hreflang code"] == ["en x2"] and bad["Invalid hreflang language code"] == ["zz"] and bad["Invalid hreflang country code"] == ["de-UK"] and bad["hreflang URL is not absolute"] == ["/zz"]
    assert len(bad["Missing return link"]) == 2 and len(bad["Language missing from hreflang"]) == 3 and {"Missing x-default", "No self-referencing hreflang", "Same URL used for several languages", "Missing <html lang>"} < set(bad)
    assert set(issues(found, 0)) == {"No hreflang tags"}


def test_images(spark, tables):
    probes = spark.createDataFrame([("https://a.org/Bad_page/12345/logo.png", 404, 0, "", 10), ("https://a.org/Bad_page/12345/c.jpg", 200, 400_000, "JPEG", 900), ("https://a.org/Bad_page/12345/20240101.jpg", 200, 9, "JPEG", 90)], "src string, status int, bytes long, format string, width int")
    bad = {k: len(v) for k, v in issues(R.image_report_rules(tables[0], probes), 1).items()}
    assert bad == {
        "Missing alt attribute": 1, "Generic alt text": 1, "Keyword-stuffed alt text": 1, "Missing width/height (causes layout shift)": 3, "Below-the-fold image not lazy-loaded": 2, "Broken image": 1, "Oversized image file": 1,
        "Served as JPEG - use WebP/AVIF": 1, "No srcset (not responsive)": 1, "Non-descriptive file name": 1, "File name not lowercase-hyphenated": 1, "Image pixels much larger than displayed": 1,
    }


def test_accessibility(tables):
    elements, facts = tables
    found = R.accessibility_report_rules(facts, elements)
    assert issues(found, 0) == {}
    assert set(issues(found, 1)) == {
        "Missing <html lang>", "No <main> landmark", "No <header> landmark", "No <nav> landmark", "No <footer> landmark", "No skip-navigation link", "Form without aria-live / role=alert region for error messages",
        "Image without alt", "Invalid ARIA attribute", "Invalid ARIA role", "aria-hidden on a focusable element", "Positive tabindex (breaks natural focus order)", "iframe without title", "Video without captions track",
    }


def test_structured_data(tables):
    elements, facts = tables
    bad = issues(R.structured_data_rules(facts, elements), 1)
    assert bad["Service missing required properties"] == ["no 'name'"] and sorted(bad["Service missing recommended properties"]) == ["no 'areaServed'", "no 'provider'", "no 'serviceType'", "no 'url'"]
    assert bad["WebSite missing required properties"] == ["no 'url'"] and bad["Same @id defined more than once"] == ["#w defined 2 times"] and bad["WebSite schema appears more than once"] == ["2"]
    assert bad["Missing or wrong @context"] == ["None"] and len(bad["JSON-LD parse error"]) == 1 and {"Missing BreadcrumbList on nested page", "FAQ section without FAQPage schema"} < set(bad)
    assert issues(R.structured_data_rules(facts, elements), 0) == {"No JSON-LD on page": ["0 JSON-LD blocks"]}


def test_content(tables):
    found = R.content_rules(tables[1], PLACEHOLDER, FILLER)
    post = issues(found, 3)
    assert post["Placeholder / test text on page"] == ["lorem ipsum"] and sorted(post["Generic AI/filler phrasing"]) == ["delve into", "in conclusion", "tapestry"]
    assert {"Article without author", "Article without publication date", "Article without updated date (dateModified)", "Empty page (almost no text)"} < set(post)
    assert issues(found, 2) == {"Empty page (almost no text)": ["0"]}


def test_content_report_makes_each_main_text_once(spark, tmp_path, monkeypatch):
    from auditloom import plans

    folder, made = str(tmp_path), []
    pages = [(1, "https://a.org/blog/x", "<main>lorem ipsum, in conclusion a tapestry; we delve into it</main>"), (2, "https://a.org/", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    write = getattr(R, "cut_lineage", None)
    monkeypatch.setattr(R, "cut_lineage", lambda df: made.append(df) or write(df), raising=False)
    out = plans.queries()["report_content"](spark, folder)
    count = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("<nav\\b")
    once = count(spark.read.parquet(f"{folder}/pages.parquet").select(R.main_text(F.col("html"))))
    assert [count(df) <= once for df in made] == [True] and count(out) == 0
    assert sorted((r.url[13:], r.issue) for r in out.where("category IN ('Style', 'Length', 'Placeholder')").collect()) == [
        ("/", "Empty page (almost no text)"), ("/blog/x", "Empty page (almost no text)"), *[("/blog/x", "Generic AI/filler phrasing")] * 3, ("/blog/x", "Placeholder / test text on page"),
    ]
