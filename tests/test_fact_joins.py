"""Joins of pages with collected facts, on literal tables and against DuckDB where the join is the point."""

import duckdb
from pyspark.sql import functions as F

from auditloom.functions import text as T
from auditloom.operators import fact_joins as J

LINKS = [("http://a.org/", 1, "internal", "http://a.org/x", "X"), ("http://a.org/", 2, "internal", "http://a.org/x", "again"), ("http://a.org/p", 1, "internal", "http://a.org/x/", "x"), ("http://a.org/p", 2, "external", "http://b.org/", "b"), ("http://a.org/p", 3, "internal", "http://a.org/r", "r"), ("http://a.org/p", 4, "external", "http://c.org/", "c"), ("http://a.org/p", 5, "internal", "http://a.org/unknown", "u"), ("http://a.org/p", 6, "other", "mailto:x", "m")]
STATUS = [("http://a.org/x", 404, 0, False), ("http://a.org/x", 200, 0, None), ("http://b.org/", 999, 0, False), ("http://a.org/r", 200, 2, False), ("http://c.org", 0, 0, False)]


def frames(spark):
    return spark.createDataFrame(LINKS, "url string, ord int, kind string, target_url string, label string"), spark.createDataFrame(STATUS, "url string, status int, hops int, is_loop boolean")


def test_link_status_reaches_every_source(spark):
    links, statuses = frames(spark)
    got = sorted((r.url, r.severity, r.issue, r.element) for r in J.link_status_rules(links, statuses).collect())
    assert got == [
        ("http://a.org/", "Important", "Broken internal link", "<a> 'X'"), ("http://a.org/p", "Important", "Broken external link", "<a> 'c'"), ("http://a.org/p", "Important", "Broken internal link", "<a> 'x'"),
        ("http://a.org/p", "Important", "Internal link redirect chain", "<a> 'r'"),
    ]
    assert J.link_status_rules(links, statuses.limit(0)).count() == J.link_status_rules(links.limit(0), statuses).count() == 0


def test_records(spark):
    rows = [("http://a.org/x?utm_source=1", 200, True, True, False, False, 10, 1), ("http://a.org/y", 301, False, False, False, False, 20, 2), ("http://a.org/z", 200, True, False, True, True, 31, 3), ("http://a.org/w", 0, None, None, None, None, None, None)]
    records = spark.createDataFrame(rows, "url string, status int, is_html boolean, in_sitemap boolean, robots_blocked boolean, js_only boolean, ms int, depth int")
    # the reference's rule: HTML with status 200, in the sitemap or its own canonical url, whatever robots.txt says
    own = {"http://a.org/x?utm_source=1": "http://a.org/x", "http://a.org/z": None}
    for canonical, kept in ((None, True), ("", True), ("http://A.org/z/#f", True), ("http://a.org/other", False)):
        own["http://a.org/z"] = canonical
        named = records.join(spark.createDataFrame(list(own.items()), "url string, canonical string"), "url", "left")
        assert {r.url for r in J.eligible_pages(named).collect()} == {"http://a.org/x?utm_source=1"} | ({"http://a.org/z"} if kept else set())
        assert J.eligible_pages(named, True).count() == 1
    assert tuple(J.crawl_statistics(records).first()) == (4, 2, 1, 1, 1, 1, 1, 20, 3)
    issues = spark.createDataFrame([("http://a.org/x", "i"), ("http://a.org/y", "j"), ("(site-wide)", "k")], "url string, issue string")
    assert {r.issue: (r.http_status, r.in_sitemap) for r in J.with_records(issues, records).collect()} == {"i": ("200", "yes"), "j": ("301", "no"), "k": ("", "")}


def test_targets_files_and_redirects(spark):
    _, statuses = frames(spark)
    pairs = spark.createDataFrame([("http://a.org/", "http://a.org/x"), ("http://a.org/p", "http://a.org/r"), ("http://a.org/q", "http://none.org/")], "url string, target string")
    assert [(r.url, r.current_value) for r in J.target_rules(pairs, statuses, "Critical", "Canonical", "Canonical target is not 200").collect()] == [("http://a.org/", "http://a.org/x -> HTTP 404")]
    uses = spark.createDataFrame([(f"p{i % 70:02}", s) for i in range(140) for s in ("a.png", "b.png")], "page string, src string")
    probes = spark.createDataFrame([("a.png", 404), ("a.png", 404), ("b.png", 200), ("c.png", 500)], "src string, status int")
    got = J.file_fan_out(uses, probes).collect()
    assert [(r.src, r.status, r.pages, r.examples) for r in got] == [("a.png", 404, 70, [f"p{i:02}" for i in range(50)])]
    links, _ = frames(spark)
    hops = spark.createDataFrame([("http://a.org/x", "http://a.org/new")], "url string, final_url string")
    assert sorted(tuple(r) for r in J.redirect_sources(hops, links).collect()) == [("http://a.org/new", "http://a.org/"), ("http://a.org/new", "http://a.org/p")]


def test_absent_and_lost_like_sql(spark):
    expected = spark.createDataFrame([("(555) 123-4567",), ("555 000 1111",)], "value string")
    found = spark.createDataFrame([("+1 555.123.4567",), (None,)], "value string")
    got = J.absent(expected, found, T.phone_key(F.col("value")), "Important", "Contact", "Confirmed phone not found").collect()
    assert [(r.url, r.current_value) for r in got] == [("(site-wide)", "555 000 1111")]
    live = [("/a", ["Service", "FAQ"], ["1"], ["x", "y"]), ("/gone", ["A"], [], [])]
    dev = [("/a", ["Service"], ["1", "2"], ["Y", "x"])]
    schema = "path string, types array<string>, phones array<string>, h2 array<string>"
    mine = sorted(tuple(r) for r in J.lost(spark.createDataFrame(live, schema), spark.createDataFrame(dev, schema)).collect())
    db = duckdb.connect()
    for name, rows in (("live", live), ("dev", dev)):
        db.execute(f"CREATE TABLE {name} (path VARCHAR, types VARCHAR[], phones VARCHAR[], h2 VARCHAR[])")
        db.executemany(f"INSERT INTO {name} VALUES (?, ?, ?, ?)", rows)
    side = "SELECT path, 'types' AS kind, unnest(types) AS value FROM {0} UNION SELECT path, 'phones', unnest(phones) FROM {0} UNION SELECT path, 'h2', unnest(h2) FROM {0}"
    sql = f"SELECT * FROM ({side.format('live')}) WHERE path IN (SELECT path FROM dev) EXCEPT ({side.format('dev')})"
    assert mine == sorted(db.execute(sql).fetchall()) == [("/a", "h2", "y"), ("/a", "types", "FAQ")]
