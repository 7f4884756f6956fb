"""Findings of a grammar engine, met with the texts they are about: kind, severity, sentence, identity, status of pages.

The engine is outside; its matches are a table (text, start, length, rule_id, category, rule_type, message,
replacements, confidence). What is known of false positives is the column `confidence`: null drops a match.

Defined cases: a position outside the text gives an empty passage, a match without replacements asks to rephrase, and a
page without text is skipped whatever was found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kind of finding of each category of the engine.
CATEGORY = {
    "TYPOS": "Spelling", "GRAMMAR": "Grammar", "PUNCTUATION": "Punctuation", "TYPOGRAPHY": "Typographical", "CASING": "Typographical", "CONFUSED_WORDS": "Word misuse", "SEMANTICS": "Word misuse",
    "COLLOCATIONS": "Word misuse", "NONSTANDARD_PHRASES": "Word misuse", "STYLE": "Style", "REDUNDANCY": "Style", "PLAIN_ENGLISH": "Style", "WIKIPEDIA": "Style", "MISC": "Style",
}
#: Severity of each kind, and the rules on white space that are never in doubt.
SEVERITY = {
    "Spelling": "Important", "Grammar": "Important", "Spacing": "Important", "Punctuation": "Optimization", "Typographical": "Optimization", "Word misuse": "Optimization", "Style": "Info",
}
CERTAIN_SPACING = ("SENTENCE_WHITESPACE", "COMMA_PARENTHESIS_WHITESPACE", "WHITESPACE_RULE", "SPACE_BEFORE_PARENTHESIS", "DOUBLE_PUNCTUATION")


def _lookup(names: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[key]


def finding_kind(category: Column, rule_id: Column, rule_type: Column) -> Column:
    """Spelling and spacing by the rule, then the kind of the category, else grammar or typography."""
    category, rule_id, rule_type = F.upper(F.coalesce(category, F.lit(""))), F.coalesce(rule_id, F.lit("")), F.coalesce(rule_type, F.lit(""))
    spelling = (category == "TYPOS") | (rule_type == "misspelling")
    spacing = F.contains(rule_id, F.lit("SPACE")) | (rule_type == "whitespace")
    other = F.when(rule_type == "grammar", "Grammar").otherwise("Typographical")
    return F.when(spelling, "Spelling").when(spacing, "Spacing").otherwise(F.coalesce(_lookup(CATEGORY, category), other))


def sentence_bounds(text: Column, start: Column, end: Column) -> Column:
    """struct(left, right): code points, from 0, of the sentence around [start, end); it ends with its mark."""
    left = F.length(F.regexp_extract(F.left(text, start), r"(?s)^(.*[.!?:] )", 1))
    rest = F.substring(text, end + 1, F.length(text))
    stop = F.length(F.regexp_extract(rest, r"(?s)^(.*?[.!?]) ", 1))
    return F.struct(left.alias("left"), F.when(stop > 0, end + stop).otherwise(F.length(text)).alias("right"))


def findings(matches: DataFrame, style: bool = False) -> DataFrame:
    """(text, rule_id, kind, severity, confidence, wrong, actual, expected, reason) of the matches that count.

    Style counts only if asked for. Texts of fewer than three words count for spelling only.
    """
    end = F.col("start") + F.col("length")
    passage = lambda a, b: F.substring("text", a + 1, b - a)
    rows = matches.where("confidence IS NOT NULL").withColumns({"k": finding_kind(F.col("category"), F.col("rule_id"), F.col("rule_type")), "wrong": passage(F.col("start"), end), "s": sentence_bounds(F.col("text"), F.col("start"), end)})
    short = F.size(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))) < 3
    rows = rows.where(((F.col("k") != "Style") | F.lit(style)) & (~short | (F.col("k") == "Spelling")))
    joined = F.startswith(F.coalesce("rule_id", F.lit("")), F.lit("EN_COMPOUNDS")) | F.contains(F.trim("wrong"), F.lit(" "))
    kind = F.when((F.col("k") == "Spelling") & joined, "Typographical").otherwise(F.col("k"))
    fix = F.get("replacements", 0)
    expected = F.when(fix.isNotNull(), F.trim(F.concat(passage(F.col("s.left"), F.col("start")), fix, passage(end, F.col("s.right"))))).otherwise("(rephrase - see reason)")
    rows = rows.withColumns({"kind": kind, "actual": F.trim(passage(F.col("s.left"), F.col("s.right"))), "expected": expected, "reason": F.trim(F.regexp_replace(F.coalesce("message", F.lit("")), r"\s+", " "))})
    severity = _lookup(SEVERITY, F.col("kind"))
    doubtful = (F.col("kind") == "Spacing") & ~F.col("rule_id").isin(*CERTAIN_SPACING)
    severity = F.when((severity == "Important") & (doubtful | (F.col("confidence") == "Low")), "Optimization").otherwise(severity)
    return rows.select("text", "rule_id", "kind", severity.alias("severity"), "confidence", "wrong", "actual", "expected", "reason")


def finding_id(kind: Column, *key: Column) -> Column:
    """A short stable name of a finding: its kind and six digits of the hash of what makes it one (url, rule, words, sentence)."""
    digest = F.md5(F.encode(F.concat_ws("|", *key), "utf-8"))
    return F.concat(F.lit("ENG-"), F.upper(F.left(kind, F.lit(4))), F.lit("-"), F.left(digest, F.lit(6)))


def page_statuses(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """(url, status, issues) of (url, blocks, note): FAIL with an important issue, WARN with any, SKIP if it could not be read."""
    grave = F.col("severity").isin("Critical", "Important")
    counts = issues.groupBy("url").agg(F.count("*").alias("issues"), F.count_if(grave).alias("grave"))
    unread = (F.coalesce("note", F.lit("")) != "") & (F.coalesce("blocks", F.lit(0)) == 0)
    status = F.when(unread, "SKIP").when(F.col("grave") > 0, "FAIL").when(F.col("issues") > 0, "WARN").otherwise("PASS")
    return pages.join(counts, "url", "left").select("url", status.alias("status"), F.coalesce("issues", F.lit(0)).alias("issues"))
