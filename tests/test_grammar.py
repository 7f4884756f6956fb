"""Findings of a grammar engine on literal texts."""

import hashlib

from pyspark.sql import functions as F

from auditloom.operators import grammar as G

TEXT = "First one. This are a  tset here! Last: end"
SCHEMA = "text string, start int, length int, rule_id string, category string, rule_type string, message string, replacements array<string>, confidence string"


def plain_bounds(text, start, end):
    """The sentence by looking for each mark, one after the other."""
    ends = [i + 2 for i in range(start - 1) if text[i] in ".!?:" and text[i + 1] == " "]
    stops = [i + 1 for i in range(end, len(text) - 1) if text[i] in ".!?" and text[i + 1] == " "]
    return max(ends, default=0), min(stops, default=len(text))


def test_sentence_bounds(spark):
    texts = [TEXT, "no marks at all", "a. b! c? d: e. ", ". . .", "é. 😀 ü! x", "line\nbreak. next\nline"]
    rows = [(t, a, min(a + w, len(t))) for t in texts for a in range(0, len(t), 3) for w in (0, 2, 5)]
    frame = spark.createDataFrame(rows, "t string, a int, b int").coalesce(1).select("t", "a", "b", G.sentence_bounds(F.col("t"), F.col("a"), F.col("b")).alias("s"))
    for r in frame.collect():
        assert (r.s.left, r.s.right) == plain_bounds(r.t, r.a, r.b), (r.t, r.a, r.b)


def test_findings(spark):
    rows = [
        (TEXT, 16, 3, "AGREE", "GRAMMAR", "grammar", "Did  you mean\n“is”?", ["is", "was"], "High"), (TEXT, 23, 4, "SPELL", "TYPOS", "misspelling", None, ["test"], "Low"), (TEXT, 21, 2, "WHITESPACE_RULE", "X", "whitespace", "m", [" "], "High"),
        (TEXT, 21, 2, "SOME_SPACE", "X", None, "m", None, "High"), (TEXT, 0, 5, "S", "STYLE", None, "m", [], "High"), (TEXT, 0, 5, "DROPPED", "GRAMMAR", None, "m", [], None), ("Log in", 0, 3, "G", "GRAMMAR", None, "m", [], "High"),
        ("Log inn", 4, 3, "SPELL", "TYPOS", None, "m", ["in"], "High"), (TEXT, 11, 8, "EN_COMPOUNDS_X", "TYPOS", None, "m", [], "High"), (None, 0, 1, None, None, None, None, None, "High"),
    ]
    matches = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.rule_id or "", r.kind, r.severity, r.wrong, r.expected) for r in G.findings(matches).where("text IS NOT NULL").collect())
    assert got == [
        ("AGREE", "Grammar", "Important", "are", "This is a  tset here!"), ("EN_COMPOUNDS_X", "Typographical", "Optimization", "This are", "(rephrase - see reason)"),
        ("SOME_SPACE", "Spacing", "Optimization", "  ", "(rephrase - see reason)"), ("SPELL", "Spelling", "Important", "inn", "Log in"), ("SPELL", "Spelling", "Optimization", "tset", "This are a  test here!"),
        ("WHITESPACE_RULE", "Spacing", "Important", "  ", "This are a tset here!"),
    ]
    assert "Style" in {r.kind for r in G.findings(matches, style=True).collect()} and G.findings(matches.limit(0)).count() == 0
    assert {r.reason for r in G.findings(matches).where("rule_id = 'AGREE'").collect()} == {"Did you mean “is”?"}
    name = spark.range(1).select(G.finding_id(F.lit("Spelling"), F.lit("u"), F.lit("é"))).first()[0]
    assert name == "ENG-SPEL-" + hashlib.md5("u|é".encode()).hexdigest()[:6]


def test_page_statuses(spark):
    pages = spark.createDataFrame([("a", 3, ""), ("b", 3, "late"), ("c", 0, "not read"), ("d", None, None), ("e", 1, None)], "url string, blocks int, note string")
    issues = spark.createDataFrame([("a", "Info"), ("b", "Info"), ("b", "Important"), ("c", "Important"), ("z", "Info")], "url string, severity string")
    assert sorted(tuple(r) for r in G.page_statuses(pages, issues).collect()) == [("a", "WARN", 1), ("b", "FAIL", 2), ("c", "SKIP", 1), ("d", "PASS", 0), ("e", "PASS", 0)]
