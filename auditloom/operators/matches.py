"""Texts checked in batches, and matches at offsets of a batch led back to their text and to every place of it.

A checker is called with the texts of a batch joined by a blank line. Texts get their place by running totals over
ranges (`sized.running_total`), so one order over all texts needs no task that holds them. A batch begins wherever
the running total passes a multiple of the limit, hence holds at most the limit and one text more. A match belongs to
the text whose range holds its offset: places of texts and matches of a batch are put in one order and each match takes
the last text before it, an as-of join within a batch, which is bounded.

Defined cases: a null text takes no place. A match that begins in the blank line between two texts, or goes beyond its
text's end, belongs to none and is left out; so is one at an offset before the first text. Empty tables give empty
results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sized import running_total

#: Characters of a batch, and what joins its texts.
BATCH_CHARS, BETWEEN = 20_000, "\n\n"
#: Control characters that a checker does not take; a space keeps every offset.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def batched(texts: DataFrame, order: list[Column], group: str | None = None, limit: int = BATCH_CHARS) -> DataFrame:
    """`texts` with `batch` and `start`, the text's offset in the joined batch; batches do not go over groups."""
    rows = texts.where("text IS NOT NULL")
    key = group or "_all"
    rows = rows if group else rows.withColumn(key, F.lit(0))
    laid = running_total(rows, key, order, F.length("text").cast("long") + len(BETWEEN), "_before")
    laid = laid.withColumn("batch", F.floor(F.col("_before") / limit))
    first = F.min("_before").over(Window.partitionBy(key, "batch"))
    laid = laid.withColumn("start", F.col("_before") - first).drop("_before")
    return laid if group else laid.drop("_all")


def joined(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, batch, text): what the checker is called with for each batch of `batched` texts."""
    parts = F.sort_array(F.collect_list(F.struct("start", "text")))
    rows = texts.groupBy(*keys, "batch").agg(F.array_join(F.transform(parts, lambda p: p["text"]), BETWEEN).alias("text"))
    return rows.withColumn("text", F.regexp_replace("text", CONTROL, " "))


def pieces(text: Column, limit: int = BATCH_CHARS) -> Column:
    """Array of struct(start, piece): a text longer than `limit` cut behind its last space in the second half of each piece.

    A piece without such a space is cut at the limit.
    """
    half = limit // 2
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,piece:string>>").alias("out"))

    def step(state: Column, _: Column) -> Column:
        at = state["at"]
        whole = F.substring(text, at + 1, F.lit(limit))
        tail = F.substring(whole, F.lit(half + 1), F.lit(limit))
        back = F.instr(F.reverse(tail), " ")
        size = F.when(at + limit >= F.length(text), F.length(whole)).when(back > 0, half + F.length(tail) - back + 1).otherwise(F.lit(limit))
        more = F.struct(at.alias("start"), F.substring(whole, F.lit(1), size).alias("piece"))
        return F.when(at >= F.length(text), state).otherwise(F.struct((at + size).alias("at"), F.array_append(state["out"], more).alias("out")))

    steps = F.sequence(F.lit(0), F.ceil(F.length(text) / max(half, 1)).cast("int"))
    return F.aggregate(steps, none, step, lambda state: state["out"])


def held(matches: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """`texts` that hold matches (keys, batch, offset, length, ...), each once, with `matches`, an array of struct(offset, length, ..., local).

    `texts` are those of `batched`. Places and lengths meet the matches, not texts, so no text is shuffled for each match.
    """
    match = F.struct(*[c for c in matches.columns if c not in (*keys, "batch")]).alias("_match")
    none = F.lit(None).cast(matches.select(match).schema[0].dataType).alias("_match")
    whole = F.struct(F.col("start").cast("long").alias("at"), F.length("text").alias("size"))
    tagged = texts.select(*keys, "batch", F.col("start").cast("long").alias("_at"), F.lit(0).alias("_kind"), whole.alias("_text"), none)
    tagged = tagged.unionByName(matches.select(*keys, "batch", F.col("offset").cast("long").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("struct<at:bigint,size:int>").alias("_text"), match))
    # at an equal place the text comes before the match
    last = F.last("_text", ignorenulls=True).over(Window.partitionBy(*keys, "batch").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = tagged.withColumn("_held", last).where("_kind = 1 AND _held IS NOT NULL").withColumn("_local", F.col("_at") - F.col("_held.at"))
    found = found.where(F.col("_local") + F.col("_match.length") <= F.col("_held.size"))
    own = [*keys, "batch"]
    found = found.groupBy(*own, F.col("_held.at").alias("_start")).agg(F.collect_list(F.struct("_match.*", F.col("_local").alias("local"))).alias("matches"))
    found = found.withColumnsRenamed({c: f"_{n}" for n, c in enumerate(own)})
    met = F.col("start").cast("long") == F.col("_start")
    for n, c in enumerate(own):
        met &= texts[c].eqNullSafe(F.col(f"_{n}"))
    return texts.join(found, met).select(*[texts[c] for c in texts.columns], "matches")


def mapped(matches: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """Matches (keys, batch, offset, length, ...) with the `text` that holds them, its other columns, and their `local` offset.

    `texts` are those of `batched`.
    """
    own = [c for c in texts.columns if c not in (*keys, "batch", "start", "text")]
    return held(matches, texts, keys).select(*keys, "batch", "start", "text", *own, F.inline("matches"))
