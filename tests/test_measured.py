"""Issues from measurements, on literal tables."""

from auditloom.operators import measured as M


def test_vitals(spark):
    rows = [("a", 2500.0, 501.0, 0.2, None), ("b", None, None, 0.26, 5801.0), ("c", 4001.0, 200.0, 0.1, 3401.0)]
    metrics = spark.createDataFrame(rows, "url string, lcp double, inp double, cls double, si double")
    assert sorted((r.url, r.severity, r.issue, r.current_value) for r in M.vitals_rules(metrics).collect()) == [
        ("a", "Critical", "INP poor", "501 ms"), ("a", "Important", "CLS needs improvement", "0.200"), ("b", "Critical", "CLS poor", "0.260"), ("b", "Important", "Speed Index poor", "5.80 s"),
        ("c", "Critical", "LCP poor", "4.00 s"), ("c", "Optimization", "Speed Index needs improvement", "3.40 s"),
    ]
    assert M.vitals(metrics.limit(0)).count() == 0


def test_lighthouse(spark):
    items = '{"items":[{"url":"u"},{"url":"v"}]}'
    rows = [
        ("a", "seo", "SEO", "is-crawlable", "Blocked", 0.0, "binary", None, None, None), ("a", "seo", "SEO", "shared", "Shared", 0.3, "binary", None, "", '{"items":[{"url":"u"}]}'), ("a", "performance", "Performance", "shared", "Shared", 0.3, "numeric", None, "2 s", items),
        ("a", "performance", "Performance", "lcp", None, 0.4, "numeric", "metrics", None, None), ("a", "best-practices", "Best Practices", "b", "B", 0.0, "binary", None, None, items), ("a", "performance", "Performance", "fine", "F", 0.9, "numeric", None, None, None),
        ("a", "performance", "Performance", "none", "N", None, "numeric", None, None, None), ("a", "performance", "Performance", "info", "I", 0.1, "informative", None, None, None),
    ]
    audits = spark.createDataFrame(rows, "url string, category_id string, category string, audit string, title string, score double, mode string, group string, shown string, details string")
    assert sorted((r.severity, r.category, r.issue, r.current_value, r.element) for r in M.lighthouse_rules(audits).collect()) == [
        ("Critical", "Lighthouse SEO", "Lighthouse: Blocked", "failed", ""), ("Important", "Lighthouse Best Practices", "Lighthouse: B", "failed (2 items)", "u; v"),
        ("Important", "Lighthouse Performance", "Lighthouse: lcp", "score 40", ""), ("Optimization", "Lighthouse Performance", "Lighthouse: Shared", "2 s (2 items)", "u; v"),
    ]
    scores = spark.createDataFrame([("a", "SEO", 49), ("a", "Performance", 50), ("b", "SEO", 90), ("c", "SEO", None)], "url string, category string, score int")
    assert sorted((r.severity, r.issue, r.current_value) for r in M.category_rules(scores).collect()) == [("Important", "Lighthouse SEO score poor", "49 / 100"), ("Optimization", "Lighthouse Performance score needs improvement", "50 / 100")]
