"""The guide's index against trying every pattern."""

import random
import re

import pytest

from auditloom.operators import guide

PATTERNS = [
    r"title (missing|too short|too long)", r"duplicate title", r"\bh1\b", r"url not seo", r"title", r"^robots\.txt reachable", r"canonical host matches|sitemap host is (the )?public", r"(font|image)s? (not )?preloaded",
    r"lcp|cls|inp", r"score .* (poor|needs improvement)", r"[0-9]+ of [0-9]+", r"a{2,}b", r"(ab)?cdef", r"(?:xyz|long literal)+ end", r"colou?r", r"é|ü", r"K elvin", r"x*", r"(?=look)ahead", r"(", r"garbled characters|mojibake$",
]


@pytest.mark.parametrize(("pattern", "want"), [(r"duplicate title", {"duplicate title"}), (r"^Robots\.txt reach", {"robots.txt reach"}), (r"ab|cdef", None), (r"abc|cdef", {"abc", "cdef"}), (r"x?abcd(e|f)", {"abcd"}), (r"(abc|defg) .* hij", {" hij"} | set()), (r"\bh1\b", None), (r".*", None), (r"é.{3}", None), (r"(", None), (r"(abcd)*", None), (r"(abcd)+", {"abcd"})])
def test_literals_that_a_match_needs(pattern, want):
    got = guide.required_literals(pattern)
    assert got == want or pattern == r"(abc|defg) .* hij" and got in ({" hij"}, {"abc", "defg"})


def texts(rnd, n):
    words = "title missing too short long duplicate h1 url not seo robots.txt reachable canonical host matches sitemap is the public font fonts images preloaded lcp score poor needs improvement 3 of 4 aab abb cdef xyz long literal end color colour é Ü K elvin look garbled characters mojibake".split(" ")
    return ["".join(rnd.choice([w, w.upper(), w.title()]) + rnd.choice([" ", " ", "", "-"]) for w in rnd.choices(words, k=rnd.randrange(6))) for _ in range(n)]


def test_guide_is_that_of_trying_every_pattern(spark):
    rnd = random.Random(1)
    rows = [(i, t, rnd.choice(["Images", "links", "none", None])) for i, t in enumerate(texts(rnd, 10_000))] + [(-1, None, "links"), (-2, "", "links"), (-3, "title", None)]
    good = [p for p in PATTERNS if p != "("]
    rules = spark.createDataFrame([(n, p, f"d{n}", n) for n, p in enumerate(good)][::-1] + [(99, None, "never", 0)], "ord int, pattern string, description string, fix int")
    for no_x in (False, True):
        table = rules.where("pattern <> 'x*'") if no_x else rules
        fallbacks = spark.createDataFrame([("images", "fi", 1), ("links", "fl", 2)], "category string, description string, fix int")
        got = {r.i: (r.description, r.fix) for r in guide.guided(spark.createDataFrame(rows, "i int, text string, category string").repartition(5), "text", table, fallbacks, "category").collect()}
        compiled = [(n, re.compile(p, re.I)) for n, p in enumerate(good) if not (no_x and p == "x*")]
        other = {"images": ("fi", 1), "links": ("fl", 2)}
        for i, t, c in rows:
            n = next((n for n, p in compiled if t is not None and p.search(t)), None)
            assert got[i] == ((f"d{n}", n) if n is not None else other.get((c or "").lower(), (None, None))), (t, n)
    assert guide.guided(spark.createDataFrame([], "text string"), "text", rules).count() == 0
    none = guide.guided(spark.createDataFrame([("a",)], "text string"), "text", rules.limit(0))
    assert [tuple(r) for r in none.collect()] == [("a", None, None)]


def test_few_patterns_are_tried_for_each_text():
    patterns = [f"{a} {b}" for a in ("broken", "missing", "slow", "empty") for b in ("title", "image", "link", "font", "frame", "label", "header", "footer")]
    index = guide.gram_index(patterns)
    assert all(gram for gram, _ in index) and {n for _, n in index} == set(range(len(patterns)))
    text = "the page has a broken image"
    grams = {text[i : i + 3] for i in range(len(text) - 2)}
    assert sum(g in grams for g, _ in index) <= 12
