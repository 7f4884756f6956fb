"""Evidence of words and the confidence of findings, against a plain walk over the same texts."""

import itertools
import json
import random
import re
from collections import defaultdict

import pytest

from auditloom.operators import evidence as E

SCHEMA = "id int, text string, start int, length int, rule_id string, category string, rule_type string, message string, replacements array<string>"


def matches(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def words(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "word string")


def test_word_counts(spark):
    texts = [("a", "Redis and redis"), ("b", "redis AND it’s"), ("b", "redis AND it’s"), (None, "redis only"), ("c", None), ("c", "")]
    want, marks = defaultdict(set), defaultdict(set)
    for page, text in texts:
        for w in set(re.findall(E.WORD, (text or "").lower())):
            marks[w].add(text)
            want[w] |= {page} if page else set()
    got = {r.word: (r.n_pages, r.n_texts) for r in E.word_counts(spark.createDataFrame(texts, "page string, text string")).collect()}
    assert got == {w: (len(want[w]), len(marks[w])) for w in marks} and got["redis"] == (2, 3)
    some = E.word_counts(spark.createDataFrame(texts, "page string, text string"), words(spark, "redis", "absent"))
    assert [tuple(r) for r in some.collect()] == [("redis", 2, 3)]


@pytest.mark.parametrize("again", [0, 100])
def test_word_counts_of_repeated_pages_and_texts(spark, monkeypatch, again):
    monkeypatch.setattr(E, "AGAIN_ROWS", again, raising=False)
    rnd = random.Random(4)
    pool = [" ".join(rnd.choice(["redis", "cache", "don't", "Blog", "ab"]) for _ in range(rnd.randrange(4))) for _ in range(30)] + [None]
    texts = [(rnd.choice([None, *range(60)]), rnd.choice(pool)) for _ in range(90)]
    frame = spark.createDataFrame(texts, "page int, text string")
    met = {}
    for page, text in texts:
        for word in set(re.findall(E.WORD, (text or "").lower())):
            met.setdefault(word, []).append((page, text))
    want = {w: (len({p for p, _ in r if p is not None}), len({t for _, t in r})) for w, r in met.items()}
    counts = E.word_counts(frame)
    assert {r.word: (r.n_pages, r.n_texts) for r in counts.collect()} == want
    assert {r.word: (r.n_pages, r.n_texts) for r in E.word_counts(frame, words(spark, "redis", "absent")).collect()} == {"redis": want["redis"]}
    # words of every text are not written out twice to be told apart
    assert "Expand" not in counts._jdf.queryExecution().optimizedPlan().toString()


def test_terms(spark):
    files = [json.dumps({"dependencies": {"@Types/node-fetch": "1", "left_pad2": "^1"}, "scripts": {"build:css": "x", "404": "y"}, "name": "hidden"}), "no json", "[1]", "{}", None, '{"dependencies": ["list"]}']
    got = {r.word for r in E.project_terms(spark.createDataFrame([(f,) for f in files], "text string")).collect()}
    assert got == {"types", "node", "fetch", "left", "pad2", "build", "css"}
    urls = ["https://Host.org/Tech/prisma-orm?x=Query1", "https://host.org", "/rel/path", None, ""]
    assert {r.word for r in E.url_terms(spark.createDataFrame([(u,) for u in urls], "url string")).collect()} == {"tech", "prisma", "orm", "query1", "rel", "path", "host", "org"}


def test_compounds_equal_trying_every_cut(spark):
    known = ["note", "book", "tool", "grid", "data", "in", "up"]
    asked = ["".join(p) for n in (1, 2, 3) for p in itertools.product(["note", "book", "sub", "set", "xq", "up", "re"], repeat=n)] + ["a", "", "grid", "subgrid", "dataset", "regrid"]

    def plain(w):
        if len(w) < 5:
            return False
        one = [w[len(p):] for p in E.PREFIXES if w.startswith(p) and len(w) > len(p) + 2] + [w[: -len(s)] for s in E.SUFFIXES if w.endswith(s) and len(w) > len(s) + 2]
        return any(r in known for r in one) or any(w[:i] in known and w[i:] in known for i in range(3, len(w) - 2))

    got = {r.word for r in E.compounds(words(spark, *asked), words(spark, *known)).collect()}
    assert got == {w for w in asked if plain(w)} and {"notebook", "subgrid", "dataset"} <= got


def spelled(i, text, wrong, *replacements, message="m"):
    return (i, text, text.index(wrong), len(wrong), "S", "TYPOS", "misspelling", message, list(replacements))


def test_confidence_of_misspellings(spark):
    cases = {
        "High": [("a vehical here", "vehical", "vehicel"), ("Vehicl", "Vehicl", "Vehicle"), ("'teh'", "'teh'", "te")],
        "Medium": [("a vehiicall here", "vehiicall", "vehical"), ("the issuesthat came", "issuesthat", "issues tha")],
        "Low": [("a zzyxa here", "zzyxa", "another")],
        None: [
            ("no idea", "idea"), ("our prisma orm", "prisma", "prism"), ("the known word", "known", "knows"), ("an HTMX page", "HTMX", "HTML"), ("myName here", "myName", "my Name"), ("next.confg here", "confg", "config"),
            ("the confg/ folder", "confg", "config"), ("un-cachd text", "un-cachd", "uncached"), ("a pnpm tool", "pnpm", "pump"), ("a notebook lies", "notebook", "notebooks"), ("we organise it", "organise", "organize"),
            ("the english text", "english", "English"), ("a wealthtech firm", "wealthtech", "wealth tech"), ("Ahmedabad is far", "Ahmedabad", "abandoned"), ("thrice ownedword", "ownedword", "another one"),
        ],
    }
    rows = [spelled(i, *case) for i, case in enumerate(c for part in cases.values() for c in part)]
    rows.append(spelled(100, "we colr it", "colr", "color", message="A British form"))
    counts = spark.createDataFrame([("ownedword", 3, 1), ("zzyxa", 2, 2)], "word string, n_pages long, n_texts long")
    known, terms = words(spark, "known", "note", "book", "the"), words(spark, "prisma", "prisma")
    got = {r.id: (r.kind, r.confidence) for r in E.confident(matches(spark, rows), counts, known, terms).collect()}
    want = [level for level, part in cases.items() for _ in part]
    assert [got[i] for i in range(len(want))] == [("Spelling", w) for w in want] and got[100] == ("Spelling", None)
    # a missing space between two words, one of which is a word that says nothing by itself, is a mistake
    one = E.confident(matches(spark, [spelled(1, "issuesthat", "issuesthat", "issues that")]), counts, known, terms).first()
    assert one.confidence == "High"


def test_confidence_of_other_findings(spark):
    rows = [
        (1, "It ends.Then more", 8, 4, "SENTENCE_WHITESPACE", "X", None, None, ["x"]), (2, "In S.Gandhi Road", 5, 6, "SENTENCE_WHITESPACE", "X", None, None, ["x"]), (3, "use sync.Pool", 9, 4, "SENTENCE_WHITESPACE", "X", None, None, ["x"]),
        (4, "the .gitlab file", 3, 3, "COMMA_PARENTHESIS_WHITESPACE", "X", None, None, ["x"]), (5, "word , more", 4, 2, "COMMA_PARENTHESIS_WHITESPACE", "X", None, None, ["x"]), (6, "there", 0, 5, "R", "CONFUSED_WORDS", None, None, ["a"]),
        (7, "very nice", 0, 4, "R", "STYLE", None, None, ["a"]), (8, "he were", 3, 4, "R", "GRAMMAR", None, None, ["was"]), (9, "he were", 3, 4, "R", "GRAMMAR", None, None, ["was", "is"]), (10, "he were", 3, 4, "R", "GRAMMAR", None, None, None),
        (11, None, 3, 4, "R", "GRAMMAR", None, None, ["a"]), (12, None, 0, 4, None, "TYPOS", None, None, ["a"]), (13, "ab", 9, 4, "S", "TYPOS", None, None, ["a"]), (14, "x", None, None, None, None, None, None, None),
    ]
    none = spark.createDataFrame([], "word string, n_pages long, n_texts long")
    frame = matches(spark, rows)
    got = {r.id: r.confidence for r in E.confident(frame, none, words(spark), words(spark)).collect()}
    assert got == {1: "High", 2: None, 3: "Low", 4: None, 5: "High", 6: "Medium", 7: "Low", 8: "High", 9: "Medium", 10: "Low", 11: "High", 12: None, 13: None, 14: "Low"}
    empty = E.confident(frame.limit(0), none, words(spark), words(spark))
    assert empty.count() == 0 and {"id", "kind", "confidence"} <= set(empty.columns)
