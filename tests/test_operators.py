"""Operators on small literal tables, for what the stored pages do not contain."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from auditloom.functions import text as T
from auditloom.functions import urls as U
from auditloom.operators import element_rules, graph, metrics, rules, scoring, similarity
from auditloom.sources import elements, tables
from auditloom.streaming import incremental


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "url, norm, path, key, clean",
    [
        ("HTTPS://Www.A.com/x/?b=1#f", "https://www.a.com/x?b=1", "/x", "/x?b=1", "https://www.a.com/x/?b=1"),
        ("http://a.com", "http://a.com/", "/", "/", "http://a.com/"),
        ("http://a.com/p?utm_source=x&q=1&gclid=2", "http://a.com/p?utm_source=x&q=1&gclid=2", "/p", "/p?utm_source=x&q=1&gclid=2", "http://a.com/p?q=1"),
    ],
)
def test_url_forms(spark, url, norm, path, key, clean):
    assert [one(spark, url, f) for f in (U.norm, U.path, U.path_key, U.clean)] == [norm, path, key, clean]
    assert one(spark, url, U.bare_host) == "a.com"


@pytest.mark.parametrize("href, full", [("/b", "http://a.com/b"), ("b", "http://a.com/x/b"), ("//c.com/d", "http://c.com/d"), ("?q=2", "http://a.com/x/y?q=2"), ("#t", "http://a.com/x/y#t"), ("mailto:a@b.c", "mailto:a@b.c"), ("https://d.com", "https://d.com")])
def test_resolve(spark, href, full):
    assert one(spark, href, lambda h: U.resolve(F.lit("http://a.com/x/y"), h)) == full


def test_text_measures(spark):
    assert one(spark, "x" * 30, lambda c: T.clip(c, 10)) == "x" * 7 + "..."
    assert [one(spark, w, T.syllables) for w in ("cat", "make", "the", "area")] == [1, 1, 1, 2]
    assert one(spark, "(555) 123-4567 ext", T.phone_key) == "5551234567"
    for score, name in ((None, "Not measured"), (95, "Excellent"), (80, "Good"), (70, "Needs Improvement"), (50, "Poor"), (1, "Critical")):
        assert one(spark, None, lambda c, s=score: T.grade(F.lit(s).cast("double"))) == name
    assert [one(spark, None, lambda c, v=v: T.rate(F.lit(v), 2.5, 4.0)) for v in (2.5, 4.0, 4.1)] == ["Good", "Needs improvement", "Poor"]


HTML = """<html><head><title>T</title><meta property="og:title" content="x"></head><body><header><nav><a href="/a">A</a></nav></header>
<h2>Start</h2><h1>One</h1><h3>Deep</h3><h3>deep</h3><h1></h1><p>a<p>b <img src="i.png"><img src="j" alt="j.png" width="1" height="2">
<div id="d"></div><div id="d"></div><button></button><input id="q" name="q"><label for="r">R</label><input id="r">
<div aria-labelledby="nope d"></div><form><input type="email" name="e"></form>
<script type="application/ld+json">{"@graph":[{"@type":"Organization","founder":{"@type":["Person","Thing"]}}]}</script>
<script type="application/ld+json">{bad</script><footer><a href="/f"></a></footer></body></html>"""


@pytest.fixture(scope="module")
def parsed(spark):
    pages = spark.createDataFrame([("http://a.com/", HTML), ("http://a.com/e", ""), ("http://a.com/n", None)], "url string, html string")
    return elements.html_elements(pages).cache()


def issues(frame):
    out = defaultdict(int)
    for r in frame.collect():
        out[r.issue] += 1
    return dict(out)


def test_elements(parsed):
    rows = {(r.tag, r.ord): r for r in parsed.collect()}
    assert [r.text for r in parsed.where("tag = 'p'").orderBy("ord").collect()][0] == "a"
    assert {r.zone for r in rows.values() if r.tag == "a"} == {"header", "footer"}
    assert parsed.where("error IS NOT NULL").count() == 0
    assert elements.text_blocks(parsed).where("tag = 'h3'").count() == 2


def test_heading_rules(parsed):
    assert issues(element_rules.heading_rules(parsed)) == {"First heading is not H1": 1, "Multiple H1": 1, "Skipped heading level": 1, "Empty heading": 1, "Duplicate heading text on page": 2}


def test_other_element_rules(parsed):
    assert issues(element_rules.image_rules(parsed)) == {"Image without alt attribute": 1, "Image without width/height": 1, "Alt text is a file name": 1}
    assert [tuple(r) for r in element_rules.duplicate_ids(parsed).collect()] == [("http://a.com/", "d", 2)]
    found = issues(element_rules.accessibility_rules(parsed))
    assert found == {"Button without accessible name": 1, "Link without text or accessible name": 1, "html without lang": 1, "Form field without label": 2, "ARIA reference to a missing id": 1}
    assert issues(element_rules.social_rules(parsed)) == {f"{k} missing": 1 for k in ("og:description", "og:image", "og:url", "og:type", "twitter:card")}
    assert [tuple(r) for r in element_rules.forms(parsed).collect()] == [("input:email:e", 1, 1)]
    assert sorted(r.type for r in elements.jsonld_nodes(parsed).collect()) == ["(invalid)", "Organization", "Person", "Thing"]


def test_security_rules(spark):
    rows = [("https://a.com/", {"Set-Cookie": "a=1; Path=/, b=2; Secure; SameSite=Lax", "Strict-Transport-Security": "max-age=60", "X-Content-Type-Options": "nosniff", "Server": "nginx/1.2", "Content-Security-Policy": "script-src 'self' 'unsafe-inline'; frame-ancestors 'none'"})]
    found = issues(element_rules.security_rules(spark.createDataFrame(rows, "url string, headers map<string,string>")))
    assert found == {"Missing referrer-policy": 1, "Missing permissions-policy": 1, "Weak CSP for scripts ('unsafe-inline' or *)": 1, "HSTS max-age below 180 days": 1, "server header reveals server software": 1, "Cookie without Secure flag": 1, "Cookie without SameSite": 1}


def test_scores(spark):
    pages = spark.createDataFrame([("a",), ("b",)], "url string")
    rows = [("a", "Critical", "T", "x", "", "", "r")] * 2 + [("a", "Optimization", "T", "y", "", "", "r"), ("(site-wide)", "Important", "S", "z", "", "", "r"), ("other", "Important", "S", "z", "", "", "r")]
    found = spark.createDataFrame(rows, "url string, severity string, category string, issue string, current_value string, element string, report string")
    assert {r.url: (r.score, r.grade) for r in scoring.page_scores(pages, found).collect()} == {"a": (73.0, "Needs Improvement"), "b": (100.0, "Excellent")}
    assert tuple(scoring.report_score(pages, found).first()) == (82.5, "Good")
    many = found.where("url = 'b'").union(spark.createDataFrame([("b", "Info", "T", "m", f"{i:03}", "e", "r") for i in range(60)], found.schema))
    capped = scoring.cap_issues(many).collect()
    assert len(capped) == 51 and [r.element for r in capped if r.current_value == "10 more occurrences not listed"] == [""]
    assert scoring.report_score(pages.limit(0), found.limit(0)).first().score == 100.0


@pytest.mark.parametrize("worst, undone, ran, human, status", [("Critical", False, True, None, "FAIL"), ("Optimization", False, True, None, "WARN"), (None, False, True, None, "PASS"), (None, True, True, None, "SKIP"), (None, False, False, None, "SKIP"), ("Critical", False, True, "pass", "PASS")])
def test_checklist(spark, worst, undone, ran, human, status):
    schema = "url string, severity string, category string, issue string, current_value string, element string, report string"
    rows = ([("u", worst, "c", "broken link", "", "", "r")] if worst else []) + ([("u", "Info", "c", "Not checked: broken link", "", "", "r")] if undone else []) + [("u", "Critical", "c", "Page not reachable", "", "", "r")]
    checks = spark.createDataFrame([("K", "AUTO", ["Critical", "Important"])], "id string, kind string, fails array<string>")
    sources = spark.createDataFrame([("K", "r", "broken", None, None)], "id string, report string, issue_re string, category_re string, exclude_re string")
    said = spark.createDataFrame([("K", human, "")] if human else [], "id string, status string, server string")
    got = scoring.checklist(checks, sources, spark.createDataFrame(rows, schema), spark.createDataFrame([("r",)] if ran else [], "report string"), said).first()
    assert got.status == status


def test_graph(spark):
    rnd = random.Random(3)
    edges = {("g", rnd.randrange(40), rnd.randrange(40)) for _ in range(70)}
    depth, frontier = {0: 0}, {0}
    while frontier:
        frontier = {b for _, a, b in edges if a in frontier} - set(depth)
        depth |= dict.fromkeys(frontier, max(depth.values()) + 1)
    frame = spark.createDataFrame(sorted(edges), "graph string, src long, dst long")
    got = graph.bfs_depth(frame, spark.createDataFrame([("g", 0)], "graph string, node long"))
    assert {r.node: r.depth for r in got.collect()} == depth


def test_redirects_stop_before_a_url_they_have_been_at(spark):
    chain = [(f"r{i:02}", f"r{i + 1:02}") for i in range(11)]
    rows = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("s", "s"), ("p", "q"), ("q", "r"), ("r", "q"), ("two", "z"), ("two", "a"), (None, "a"), ("end", None), *chain]
    got = {r.url: (r.final_url, r.hops, r.is_loop) for r in graph.redirect_closure(spark.createDataFrame(rows, "url string, location string")).collect()}
    assert got == {
        "a": ("c", 2, False), "b": ("c", 1, False), "x": ("y", 1, True), "y": ("x", 1, True), "s": ("s", 0, True), "p": ("r", 2, True), "q": ("r", 1, True), "r": ("q", 1, True), "two": ("c", 3, False),
        "r00": ("r10", 10, True), "r01": ("r11", 10, True), **{f"r{i:02}": ("r11", 11 - i, False) for i in range(2, 11)},
    }
    assert graph.redirect_closure(spark.createDataFrame([], "url string, location string")).count() == 0


def test_all_depths(spark):
    chain = [("g", f"{i:03}", f"{i + 1:03}") for i in range(55)] + [("g", "x", "y"), ("g", "y", "x"), ("g", "z", "000")]
    nodes = spark.createDataFrame([("g", "alone")], "graph string, node string")
    got = {r.node: (r.depth, r.linked) for r in graph.all_depths(nodes, spark.createDataFrame(chain, "graph string, src string, dst string"), spark.createDataFrame([("g", "000")], "graph string, node string")).collect()}
    assert got == {f"{i:03}": (i, True) for i in range(56)} | {"x": (None, True), "y": (None, True), "z": (None, False), "alone": (None, False)}


def test_click_depth(spark, tmp_path):
    from auditloom import plans

    to = {"/": ["/a", "/b"], "/a": ["/b", "/c"], "/c": ["/d"], "/d": ["/e", "/"], "/x": ["/y"], "/y": ["/x"], "/o": ["/a"]}
    rows = [(i, f"http://s.com{p}", "<html><body>" + "".join(f'<a href="{t}">t</a>' for t in ts) + "</body></html>") for i, (p, ts) in enumerate(to.items())]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.node: (r.depth, r.problem) for r in plans.queries()["click_depth"](spark, str(tmp_path)).collect()}
    far, lost = "Page too deep", "Not reachable from homepage by links"
    assert got == {"/": (0, None), "/a": (1, None), "/b": (1, None), "/c": (2, None), "/d": (3, None), "/e": (4, far), "/x": (None, lost), "/y": (None, lost), "/o": (None, "Orphan page")}


def test_metrics(spark):
    rows = spark.createDataFrame([("g", 0, 10), ("g", 5, 12), ("g", 20, 21), ("g", 3, 4), ("h", 1, 1)], "g string, a long, b long")
    assert {r.g: r.covered for r in metrics.interval_union(rows, "g", "a", "b").collect()} == {"g": 13, "h": 0}
    assert {r.g: r.a for r in metrics.upper_median(rows, "g", "a").collect()} == {"g": 5, "h": 1}
    many = spark.createDataFrame([("g", float(i)) for i in range(120)], "g string, v double")
    assert metrics.slowest_but(many, "g", "v").first().v == 117.0


def test_near_duplicates_crc32(spark):
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(99)}" for _ in range(300)]
    texts = []
    for i in range(40):
        w = base[:] if i % 2 else [f"v{rnd.randrange(9999)}" for _ in range(80)]
        for _ in range(rnd.randrange(0, 4)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(99)}"
        texts.append((i, w))
    frame = spark.createDataFrame(texts, "id long, w array<string>").select("id", similarity.signature(similarity.shingle_hashes_crc32("w")).alias("sig")).cache()
    sig = {r.id: r.sig for r in frame.collect()}
    heads = {min(j for j in sig if sig[j] == s): s for s in sig.values()}
    want = {(a, b) for a in heads for b in heads if a < b and sum(x == y for x, y in zip(sig[a], sig[b], strict=True)) >= 87}
    assert {(r.a, r.b) for r in similarity.near_pairs(frame).collect()} == want and want


def test_near_duplicate_members(spark):
    copy, other = [1] * 96, [1] * 90 + [2] * 6
    frame = spark.createDataFrame([(5, copy), (2, copy), (9, other), (7, copy), (8, other), (3, [4] * 96)], "id long, sig array<long>")
    assert {r.id: r.rep for r in similarity.members(frame).collect()} == {2: 2, 5: 2, 7: 2, 8: 8, 9: 8, 3: 3}
    assert [(r.a, r.b) for r in similarity.near_pairs(frame).collect()] == [(2, 8)]
    alike = frame.where("id IN (2, 5, 7)")
    assert similarity.near_pairs(alike).count() == 0 and {r.rep for r in similarity.members(alike).collect()} == {2}


def test_members_make_each_signature_once(spark, tmp_path, monkeypatch):
    from auditloom import plans

    plans_made = []
    write = similarity.cut_lineage
    monkeypatch.setattr(similarity, "cut_lineage", lambda df: plans_made.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    long = " ".join(f"w{i % 700}" for i in range(3000))
    docs = [(1, long, "en"), (2, long.upper(), "en"), (3, "one", None), (4, None, None), (5, " ", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("near_duplicate_members_md5", "near_duplicate_members_crc32"):
        assert {r.doc_id: r.rep for r in plans.queries()[name](spark, str(tmp_path)).collect()} == {1: 1, 2: 1, 3: 3}
    assert [p.count("ArrowEvalPython") for p in plans_made] == [1, 1]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_misspellings(spark, tmp_path):
    from auditloom import plans

    rnd = random.Random(5)
    n = {"vehicle": 9, "medical": 40, "vesical": 5, "vehical": 1, "cat": 7, "act": 2, "of": 8, "teh": 1, "the": 30}
    n |= {"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 7))): rnd.randrange(1, 9) for _ in range(60)}
    text = " ".join(w for w, k in n.items() for _ in range(k))
    spark.createDataFrame([(1, "en", text)], "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {(a, b, edits(a, b)) for a in n for b in n if a != b and 3 <= len(a) <= 18 and n[b] >= 4 and n[a] < n[b] and edits(a, b) <= 2}
    got = plans.queries()["misspellings"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and ("vehical", "vehicle", 2) in want and ("teh", "the", 2) in want
    best = {r.word: r.suggestion for r in plans.queries()["ranked_misspellings"](spark, str(tmp_path)).where("rn = 1").collect()}
    assert best["vehical"] == "vehicle" and set(best) == {a for a, _, _ in want}


def test_filler_texts(spark, tmp_path):
    from auditloom import plans

    texts = ["In today's fast-paced world we DELVE into a tapestry", "the end of the day and the menu, licensed under x, in conclusion", "delve into it, in conclusion: in conclusion", None]
    spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in plans.queries()["filler_texts"](spark, str(tmp_path)).collect()] == [(0, 3)]


def test_sources(spark):
    xml = spark.createDataFrame([("<urlset><url><loc> http://a/1 </loc><lastmod>2026-01</lastmod></url><url><loc>http://a/2</loc></url></urlset>",)], "xml string")
    assert sorted(map(tuple, tables.sitemap_entries(xml).collect()), key=str) == [("http://a/1", "2026-01"), ("http://a/2", None)]
    body = "User-agent: *\nDisallow: /x # no\nAllow: /x/y\nUser-agent: bot\nDisallow: /\nSitemap: http://a/s.xml"
    found = tables.robots_rules(spark.createDataFrame([("a", body)], "host string, body string"))
    asked = spark.createDataFrame([("a", "/x/1"), ("a", "/x/y/2"), ("a", "/z"), ("b", "/x")], "host string, path string")
    assert {(r.host, r.path): r.allowed for r in tables.robots_allowed(asked, found).collect()} == {("a", "/x/1"): False, ("a", "/x/y/2"): False, ("a", "/z"): True, ("b", "/x"): True}
    reports = spark.createDataFrame([("k", "2026-01-01", "10", 1.0), ("k", "2026-01-02", "09", 2.0)], "key string, date string, time string, score double")
    assert tables.latest_reports(reports).first().score == 2.0


def test_rules_fire_once_each(spark):
    rows = spark.createDataFrame([("u", 1), ("v", None)], "url string, n int")
    got = rules.evaluate(rows, [rules.Rule("Info", "c", "low", F.col("n") < 2, F.col("n")), rules.Rule("Info", "c", "null", F.col("n").isNull())])
    assert {(r.url, r.issue, r.current_value) for r in got.collect()} == {("u", "low", "1"), ("v", "null", "")}


def test_streaming(spark, tmp_path):
    spark.createDataFrame([("a", "2026-01-01 00:00:00", 1.0), ("a", "2026-01-01 00:30:00", 3.0), ("b", "2026-01-01 01:10:00", 5.0)], "url string, ts string, value double").select("url", F.to_timestamp("ts").alias("ts"), "value").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string, ts timestamp, value double").parquet(str(tmp_path / "in"))
    for name, frame, mode in (("seen", incremental.new_urls(stream), "append"), ("windows", incremental.windowed_metrics(stream, "ts", "url", "value"), "complete")):
        query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    assert spark.table("seen").count() == 2
    assert {(r.url, r.n, r["mean"]) for r in spark.table("windows").collect()} == {("a", 2, 2.0), ("b", 1, 5.0)}


def test_reports(spark, tmp_path):
    from auditloom.operators import reports

    schema = "url string, severity string, category string, issue string, current_value string, element string, report string"
    rows = [("http://a/2", "Info", "c", "i", "x\x01y", None, "r"), ("http://a/1", "Important", "c", "i", "v", "e", "r"), ("(site-wide)", "Critical", "c", "i", "v", "e", "s"), ("http://a/1", "Critical", "c", "i", "v", "e", "r")]
    found = spark.createDataFrame(rows, schema)
    assert [r.url for r in reports.ordered(found).collect()] == ["http://a/1", "http://a/1", "http://a/2", "(site-wide)"]
    nested = {r.url: r for r in reports.documents(found).collect()}
    assert [i.severity for i in nested["http://a/1"]["issues"]] == ["Critical", "Important"] and nested["http://a/1"].critical == 1
    for _ in range(2):
        reports.write(found, str(tmp_path / "out"), "2026-01-01")
    reports.write(found.limit(0).union(found.where("report = 's'")), str(tmp_path / "out"), "2026-01-02")
    back = spark.read.parquet(str(tmp_path / "out/issues"))
    assert back.count() == 5 and spark.read.json(str(tmp_path / "out/json")).count() == 4
    csv = spark.read.option("header", True).csv(str(tmp_path / "out/csv")).where("severity = 'Info'").first()
    assert csv.current_value == "xy"
    cells = reports.clean_cells(spark.createDataFrame([([1, 2], None)], "a array<int>, b string")).first()
    assert tuple(cells) == ("[1,2]", "")
    old = spark.createDataFrame([("A", "pass"), ("B", "fail")], "id string, status string")
    new = spark.createDataFrame([("A", None), ("B", "pass"), ("C", "fail")], "id string, status string")
    assert sorted(map(tuple, reports.upsert(old, new).collect())) == [("B", "pass"), ("C", "fail")]


ROBOTS = [
    "User-agent: *\nUser-agent: y\nDisallow: /q\n", "User-agent: y\nAllow: /q/ok\nDisallow: /q\n\nUser-agent: *\nDisallow: /z\nAllow: /z/in\n", "Disallow: /q\n", "",
    "User-agent: *\nDisallow:\n", "# c\nUser-Agent: * # all\n\nDisallow: /q\n", "User-agent: *\nDisallow: /q\n\nDisallow: /z\n\nUser-agent: *\nDisallow: /\n",
    "User-agent: Yahoo\nDisallow: /\n\nUser-agent: yes\nuser-agent: *\nAllow: /\nDisallow: /q", "User-agent: y\nUser-agent: z\nCrawl-delay: 3\nDisallow: /q\nSitemap: http://s/x.xml\nDisallow: /z\n",
]


@pytest.mark.parametrize("agent", ["*", "y", "Yes/2.0"])
def test_robots_like_the_standard_parser(spark, agent):
    from urllib.robotparser import RobotFileParser

    paths = ["/", "/q", "/q/ok", "/q/x", "/z", "/z/in", "/other"]
    bodies = [(f"h{i}", b) for i, b in enumerate(ROBOTS)]
    rules_ = tables.robots_rules(spark.createDataFrame(bodies, "host string, body string"))
    urls = spark.createDataFrame([(h, p) for h, _ in bodies for p in paths], "host string, path string")
    got = {(r.host, r.path): r.allowed for r in tables.robots_allowed(urls, rules_, agent).collect()}
    for host, body in bodies:
        parser = RobotFileParser()
        parser.parse(body.splitlines())
        assert {p: got[host, p] for p in paths} == {p: parser.can_fetch(agent, p) for p in paths}, body


@pytest.mark.parametrize("href", ["../b", "./b", "../../b", "a/./b/../c", "/x/../y", ".", "..", "../?q=1", "b/..", "http://d.org/a/../b#f"])
def test_resolve_dot_segments(spark, href):
    from urllib.parse import urljoin

    assert one(spark, href, lambda h: U.resolve(F.lit("http://a.com/x/y/z"), h)) == urljoin("http://a.com/x/y/z", href)


def test_near_pairs_with_hot_bands(spark, monkeypatch):
    """Bands of many classes are dealt over blocks; all pairs are found, whichever hash is used."""
    monkeypatch.setattr(similarity, "BLOCK", 3)
    rnd = random.Random(2)
    base = [f"w{i}" for i in range(600)]
    texts = []
    for _ in range(25):
        w = base[:]
        for _ in range(rnd.randrange(0, 4)):
            w[rnd.randrange(600)] = f"x{rnd.randrange(999)}"
        texts.append(w)
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, w array<string>")
    for hashes in (similarity.shingle_hashes_md5, similarity.shingle_hashes_crc32):
        signed = rows.select("id", similarity.signature(hashes(F.col("w"))).alias("sig"))
        sig = {r.id: r.sig for r in signed.collect()}
        rep = {r.id: r.rep for r in similarity.members(signed).collect()}
        want = {}
        for a in set(rep.values()):
            for b in set(rep.values()):
                s = sum(x == y for x, y in zip(sig[a], sig[b], strict=True)) / 96
                if a < b and s >= 0.9:
                    want[a, b] = s
        assert {(r.a, r.b): r.similarity for r in similarity.near_pairs(signed).collect()} == pytest.approx(want) and len(want) > 10


def test_crc32_shingles(spark):
    import zlib

    words = [f"é{i}" for i in range(9)]
    got = spark.createDataFrame([(words,), (words[:2],)], "w array<string>").select(similarity.shingle_hashes_crc32(F.col("w"))).collect()
    assert [sorted(r[0]) for r in got] == [sorted(zlib.crc32(" ".join(w[i : i + 5]).encode()) for i in range(max(1, len(w) - 4))) for w in (words, words[:2])]


@pytest.mark.parametrize("path, kind", [("SRC/ID_RSA", "secret"), ("A/.DS_STORE", "artefact"), ("x/Node_Modules/a.js", "artefact"), ("b/.ENV", "secret"), ("src/a.ts", "source")])
def test_repo_file_kinds_in_any_case(spark, path, kind):
    from auditloom.functions import classify as C

    p = F.col("x")
    got = one(spark, path, lambda c: F.when(p.rlike(C.SECRET_FILES), "secret").when(p.rlike(C.ARTEFACTS), "artefact").otherwise("source"))
    assert got == kind and one(spark, "/Blog/Untitled-2", lambda c: c.rlike(C.TEST_PAGE))
