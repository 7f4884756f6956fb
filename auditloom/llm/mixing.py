"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words. A document of a source with target T and S words is expected
`T / S` times (the same for each of the source's documents): the whole part
are certain copies, the rest is an inclusion probability p for one more copy. Documents are ranked by
Pareto's statistic, random odds divided by inclusion odds,

    q = (u / (1 - u)) / (p / (1 - p))

with u drawn from a hash of the document's id and text, and the smallest q are taken until the words of the
extra copies come as near to what the certain copies left open as they can.

The cut is found without ordering a source in one task: words are summed in `BINS` bins of q, running sums over
the bins (a few thousand rows a source at most) name the bin where the target is reached, and that bin is cut
into `BINS` again until it holds at most `FEW` different q. Only those are ordered. A source that holds a third
of all rows is summed before the shuffle like any other. Sources may be as many as hosts: their turns are
numbered by ranges, and the level of their targets is found by sums over all of them. Texts are read once to be
counted and never shuffled; ids, sizes and hashes are written out between.

Defined cases: a null text, or one without a word, has size 0 and takes 0 words. A text of any length is counted
whole. A null source is a source of its own, last in order. A source without words has target 0. Rows that share
an id but not the text are ranked apart. Rows that share source, id and text have one q; if the cut falls among
them, as many of them get the extra copy as come nearest to the target. Other columns are left alone. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut_lineage, numbered

BINS, FEW = 4096, 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from the first 48 bits of an md5: the same in every run, engine and partitioning."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"#{seed}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target): `share` of all words dealt by weight, at most `cap` times a source's size.

    Sources in code point order, null last, take the weights in turn. The level (words a unit of weight) starts
    at that of all sources together; those whose cap is below it are capped, and the level of the rest follows
    from what they leave open. It only rises, so the rounds end when no source is capped anew.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turns = numbered(totals, F.col("source").asc_nulls_last(), name="turn")
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    weighed = turns.withColumn("weight", F.element_at(kinds, (F.col("turn") % len(weights) + 1).cast("int")))
    most = F.col("source_size") * cap
    weighed = cut_lineage(weighed.select("source", "source_size", "weight", (most / F.col("weight")).alias("ratio")))
    level, n_capped = -1.0, -1
    while True:
        capped = F.col("ratio") <= level
        sums = weighed.agg(
            F.sum("source_size").alias("words"), F.coalesce(F.sum(F.when(capped, most)), F.lit(0.0)).alias("capped"), F.sum(F.when(~capped, F.col("weight"))).alias("weight"), F.count_if(capped).alias("n")
        ).first()
        if sums.weight is None or sums.n == n_capped:
            break
        level, n_capped = (sums.words * share - sums.capped) / sums.weight, sums.n
    target = F.when(F.col("ratio") <= level, most).otherwise(F.col("weight") * level) if sums.weight is not None else most
    return weighed.select("source", "source_size", target.cast("double").alias("target"))


def _ranked(rows: DataFrame, seed: int) -> DataFrame:
    """With q / (1 + q), which keeps the order of q and lies in (0, 1); null where no extra copy is possible."""
    u = uniform(F.concat_ws("|", F.col("key").cast("string"), "mark"), seed)
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    return rows.withColumn("q", F.when((F.col("p") > 0) & (F.col("size") > 0), odds / (1 + odds)))


def text_mark(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def source_plan(sized: DataFrame, seed: int = 1) -> DataFrame:
    """Per source source_size, target, certain copies, p, and the cut: the last (q, size) that gets an extra copy
    and how many of the rows with just these get it (`among` of `alike`).

    `sized` has key, source, size and mark (a hash of the text).
    """
    targets = source_targets(sized)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = cut_lineage(targets.withColumn("certain", F.floor(rate).cast("long")).withColumn("p", rate - F.floor(rate)))
    targets = targets.withColumn("open", F.col("target") - F.col("certain") * F.col("source_size"))
    ranked = _ranked(_meet(sized, targets), seed).where("q IS NOT NULL").select("source", "size", "q", "open")
    # words before the open interval [low, low + width) of q that the cut lies in
    inside, width = ranked.withColumns({"low": F.lit(0.0), "before": F.lit(0).cast("long")}), 1.0
    while True:
        width /= BINS
        step = F.least(F.lit(BINS - 1), F.floor((F.col("q") - F.col("low")) / width))
        bins = inside.groupBy("source", "open", "low", "before", step.cast("int").alias("bin")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("start", F.col("before") + F.sum("words").over(upto) - F.col("words"))
        cut = bins.where("start < open AND start + words >= open")
        cut = cut_lineage(cut.select("source", (F.col("low") + F.col("bin") * width).alias("low"), F.col("start").alias("before"), "n"))
        inside = _meet(ranked, cut).where((F.col("q") >= F.col("low")) & (F.col("q") < F.col("low") + width))
        if width < 2.0**-40 or cut.where(F.col("n") > FEW).limit(1).count() == 0:
            break
    # rows with one q and size are counted, so that the window orders different q only
    alike = inside.groupBy("source", "open", "before", "q", "size").agg(F.count("*").alias("alike"))
    words = F.col("size") * F.col("alike")
    alike = alike.withColumn("start", F.col("before") + F.sum(words).over(Window.partitionBy("source").orderBy("q", "size").rowsBetween(Window.unboundedPreceding, 0)) - words)
    among = F.least(F.col("alike"), F.greatest(F.lit(0), F.floor((F.col("open") - F.col("start")) / F.col("size") + 0.5))).cast("long")
    last = alike.withColumn("among", among).where("among > 0").groupBy("source").agg(F.max(F.struct("q", "size", "among", "alike")).alias("found"))
    edge = _meet(cut.select("source", F.col("low").alias("q")), last.select("source", "found"), "left")
    edge = edge.select(F.col("source").alias("last_source"), F.coalesce("found", F.struct("q", F.lit(-1).cast("long").alias("size"), F.lit(1).cast("long").alias("among"), F.lit(1).cast("long").alias("alike"))).alias("last"))
    joined = targets.join(edge, F.col("source").eqNullSafe(F.col("last_source")), "left").drop("last_source")
    # rounding can leave the target beyond the sum of all words: then all are taken
    one = F.lit(1).cast("long")
    rest = F.struct(F.when(F.col("open") > 0, 2.0).otherwise(-1.0).alias("q"), F.lit(0).cast("long").alias("size"), one.alias("among"), one.alias("alike"))
    joined = joined.withColumn("last", F.coalesce("last", rest))
    return cut_lineage(joined.select("source", "source_size", "target", "certain", "p", *[F.col(f"last.{c}").alias(f"last_{c}") for c in ("q", "size", "among", "alike")]))


_PLAN = ("certain", "p", "last_q", "last_size", "last_among", "last_alike", "q")


def copies(rows: DataFrame, plan: DataFrame, seed: int = 1) -> DataFrame:
    """The rows (with key, source, size and mark) and their source_size, target and n_copies.

    Without a shuffle for a small plan, except for rows that share the cut's q: these are counted, and the extra
    copies dealt among equal ones.
    """
    ranked = _ranked(_meet(rows, plan), seed)
    here, cut = F.struct("q", "size"), F.struct(F.col("last_q").alias("q"), F.col("last_size").alias("size"))
    split = F.coalesce((here == cut) & (F.col("last_among") < F.col("last_alike")), F.lit(False))
    extra = F.when(F.col("q").isNotNull() & (here <= cut), 1).otherwise(0)
    clear = ranked.where(~split).withColumn("n_copies", F.col("certain") + extra).drop(*_PLAN)
    # rows equal in every column are counted before the shuffle; the few that differ elsewhere take their turns in order
    every = [F.col(c) for c in rows.columns]
    tied = ranked.where(split).groupBy(*every, "source_size", "target", "certain", "last_among").agg(F.count("*").alias("_n"))
    turn = Window.partitionBy("source").orderBy(F.xxhash64(*every)).rowsBetween(Window.unboundedPreceding, 0)
    tied = tied.withColumn("_left", F.greatest(F.lit(0), F.least(F.col("_n"), F.col("last_among") - (F.sum("_n").over(turn) - F.col("_n")))))
    each = tied.withColumn("_turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    each = each.withColumn("n_copies", F.col("certain") + F.when(F.col("_turn") <= F.col("_left"), 1).otherwise(0))
    return clear.unionByName(each.select(*clear.columns))


def _meet(rows: DataFrame, per_source: DataFrame, how: str = "inner") -> DataFrame:
    """A join on the source, null with null."""
    right = per_source.withColumnRenamed("source", "its_source")
    return rows.join(F.broadcast(right) if _small(right) else right, F.col("source").eqNullSafe(F.col("its_source")), how).drop("its_source")


def _small(targets: DataFrame, rows: int = 100_000) -> bool:
    """Whether the per-source table has at most `rows` rows (about 5 MB); beyond that the joins shuffle."""
    return targets.limit(rows + 1).count() <= rows


def mix_sizes(docs: DataFrame) -> DataFrame:
    """Per document doc_id, size, source_size, target, taken."""
    sized = cut_lineage(docs.select(F.col("doc_id").alias("key"), "source", word_count(F.col("text")).alias("size"), text_mark(F.col("text")).alias("mark")))
    mixed = copies(sized, source_plan(sized))
    return mixed.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {name: f"c{names.index(name)}" for name in ("doc_id", "source", "text")}
    sized = plain.withColumns({"key": F.col(at["doc_id"]), "source": F.col(at["source"]), "size": word_count(F.col(at["text"])), "mark": text_mark(F.col(at["text"]))})
    mixed = copies(sized, source_plan(cut_lineage(sized.select("key", "source", "size", "mark"))))
    repeated = mixed.where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))))
    return repeated.select(*plain.columns).toDF(*names)
