"""First matching rule of a table of patterns, by an index of what a pattern needs.

A guide has hundreds of patterns and wants, for each text, the first that occurs in it. Every pattern is taken apart on
the driver (patterns are a parameter, short and few against the texts): a set of literals of which each match must
hold one. Each literal is looked up by its rarest trigram; a text's trigrams meet these by equality, and only the pairs
that meet are put to the regular expression. Patterns without a literal of three characters meet every text.

Letter case does not count, in patterns, texts and literals. Texts are looked up once each, however many rows
have them.

Defined cases: a null text matches nothing. A text no pattern fits gets its category's fallback, else nulls. A pattern that
cannot be taken apart meets every text. Rules that repeat an ord count in order of their pattern. Empty tables give
empty results, an empty guide only fallbacks.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sized import SMALL_ROWS, sized_join

GRAM = 3


def _needs(items) -> set[str] | None:
    """Literals of which every match of a parsed sequence holds one; None if nothing can be said."""
    best, run = None, ""

    def better(found: set[str] | None) -> None:
        nonlocal best
        if found and all(found) and (best is None or min(map(len, found)) > min(map(len, best))):
            best = found

    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            run += chr(value).lower()
            continue
        better({run})
        run = ""
        if name == "SUBPATTERN" and not value[2] and not value[1]:
            better(_needs(value[3]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] >= 1:
            better(_needs(value[2]))
        elif name == "BRANCH":
            parts = [_needs(b) for b in value[1]]
            better(set().union(*parts) if all(parts) else None)
    better({run})
    return best


def required_literals(pattern: str) -> set[str] | None:
    """Lower-case literals of which every text that the pattern occurs in holds one; None if there are none of GRAM characters."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            found = _needs(re._parser.parse(pattern))
    except (re.error, RecursionError, OverflowError):
        return None
    # letters whose other case is another letter, or several, are left to the expression
    if not found or any(len(x) < GRAM or not x.isascii() for x in found):
        return None
    return found


def gram_index(patterns: list[str]) -> list[tuple[str | None, int]]:
    """(gram, number of the pattern): a trigram of each literal, the one that the fewest literals have; None meets all."""
    needs = [required_literals(p) for p in patterns]
    count = Counter(x[i : i + GRAM] for found in needs for x in found or () for i in range(len(x) - GRAM + 1))
    out = set()
    for n, found in enumerate(needs):
        for x in found or ():
            out.add((min((x[i : i + GRAM] for i in range(len(x) - GRAM + 1)), key=lambda g: (count[g], g)), n))
        if not found:
            out.add((None, n))
    return sorted(out, key=lambda g: (g[0] or "", g[1]))


def guided(rows: DataFrame, text: str, rules: DataFrame, fallbacks: DataFrame | None = None, category: str | None = None) -> DataFrame:
    """`rows` with the columns of the first of `rules` (ord, pattern, ...) whose pattern occurs in the text.

    `fallbacks` has a lower-case `category` and the same columns but ord and pattern; it serves rows that no pattern
    fits, by their `category` column.
    """
    out = [c for c in rules.columns if c not in ("ord", "pattern")]
    table = sorted(((r["ord"], r["pattern"], *[r[c] for c in out]) for r in rules.where("pattern IS NOT NULL").collect()), key=lambda r: (r[0], r[1]))
    spark = rows.sparkSession
    texts = rows.select(F.col(text).alias("_text")).where(F.col(text).isNotNull()).distinct()
    types = {f.name: f.dataType.simpleString() for f in rules.schema.fields}
    known = spark.createDataFrame([(n, f"(?iu){r[1]}", *r[2:]) for n, r in enumerate(table)], "_n int, _pattern string" + "".join(f", {c} {types[c]}" for c in out))
    grams_of = gram_index([r[1] for r in table])
    index = spark.createDataFrame([g for g in grams_of if g[0]], "_gram string, _n int")
    always = F.array(*[F.lit(n) for gram, n in grams_of if gram is None]).cast("array<int>")
    low = F.lower("_text")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - (GRAM - 1), F.lit(1))), lambda i: F.substring(low, i, F.lit(GRAM))))
    # the guide is collected above, so both tables are known to be small
    by_gram = texts.select("_text", F.explode(grams).alias("_gram")).join(F.broadcast(index), "_gram").select("_text", "_n")
    by_all = texts.select("_text", F.explode(always).alias("_n"))
    asked = by_gram.unionByName(by_all).distinct().join(F.broadcast(known), "_n").where(F.regexp_like("_text", F.col("_pattern")))
    best = asked.groupBy("_text").agg(F.min(F.struct("_n", *out)).alias("_b"))
    met = sized_join(rows.withColumn("_text", F.col(text)), best, "_text", "left", SMALL_ROWS)
    if fallbacks is None or category is None:
        return met.select(*rows.columns, *[F.col("_b")[c].alias(c) for c in out])
    other = fallbacks.select(F.lower("category").alias("_category"), F.struct(*out).alias("_f"))
    met = sized_join(met.withColumn("_category", F.lower(F.col(category))), other, "_category", "left")
    chosen = lambda c: F.when(F.col("_b").isNotNull(), F.col("_b")[c]).otherwise(F.col("_f")[c])
    return met.select(*rows.columns, *[chosen(c).alias(c) for c in out])
