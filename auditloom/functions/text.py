"""Text measures and small classifications as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that do not name a topic.
STOPWORDS = (
    "a an and are as at be by for from how in into is it its of on or our the to we with your you services service development company solutions"
).split()


def clip(value: Column, limit: int) -> Column:
    """At most `limit` characters, the last three dots if anything was cut."""
    return F.when(F.length(value) <= limit, value).otherwise(F.concat(F.substring(value, 1, limit - 3), F.lit("...")))


def grade(score: Column) -> Column:
    return F.when(score.isNull(), "Not measured").when(score >= 90, "Excellent").when(score >= 80, "Good").when(score >= 70, "Needs Improvement").when(score >= 50, "Poor").otherwise("Critical")


def rate(value: Column, good: float, poor: float) -> Column:
    return F.when(value.isNull(), "n/a").when(value <= good, "Good").when(value > poor, "Poor").otherwise("Needs improvement")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def length_class(words: Column, empty: int = 50, short: int = 150, thin: int = 300) -> Column:
    return F.when(words < empty, "Empty page (almost no text)").when(words < short, "Very short page").when(words < thin, "Thin content")


def letters_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))


def syllables(word: Column) -> Column:
    """Vowel groups, less a final e that is not the only group; at least one."""
    w = F.lower(word)
    groups = F.regexp_count(w, F.lit("[aeiouy]+"))
    return F.greatest(F.lit(1), groups - F.when(w.endswith("e") & (groups > 1), 1).otherwise(0))


def sentences(text: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"[.!?]+(\s|$)")))


def topic_words(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9.+#]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS)))


def slug_words(path: Column) -> Column:
    words = F.split(F.lower(path), "[-/_]")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS)))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def phone_key(value: Column) -> Column:
    """The last ten digits: one number in all its spellings."""
    return F.right(digits(value), F.lit(10))


def normal_text(value: Column) -> Column:
    """Lower-cased letters and digits of any script, single-spaced."""
    return F.trim(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}_]+", " "))


def context(text: Column, at: Column, before: int, after: int) -> Column:
    """The text around the 1-based position `at`."""
    return F.substring(text, F.greatest(F.lit(1), at - before), F.lit(before + after))
