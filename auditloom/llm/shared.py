"""Cutting lineage in a folder that every executor can read, tables small enough to broadcast, global numbers."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of (id, number) that may be broadcast: a bound of about 50 MB in memory.
BROADCAST_ROWS = 1_000_000
#: Rows of any table of a few short columns that may be broadcast: about 10 MB.
SMALL_ROWS = 50_000


def shared_folder(spark) -> str:
    """The session's spark.checkpoint.dir: a folder that the driver and all executors see.

    Where it is unset, a local session (one machine, as in tests) gets a folder of its own; a cluster gets an error.
    """
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` written to the session's shared checkpoint folder and read back: lost executors do not lose it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def numbered(df: DataFrame, *order, name: str = "number", part: str | None = None) -> DataFrame:
    """`df` with the place of each row, from 0, in the given order of all rows; no task holds them all.

    Rows are dealt out by ranges of the order and sorted there; a row's number is its place within its range
    plus the sizes of the ranges before it, of which there is one for each partition. The written rows keep
    their partitions, so numbers are the same whenever they are read. Equal rows of the order are numbered as
    they come; a random last key in `order` deals a hot value over several ranges. `part` names a column for
    the number of the range, if wanted.
    """
    width = F.lit(1 << 33)
    laid = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_at", F.monotonically_increasing_id())
    sizes = {r.part: r.n for r in laid.groupBy(F.floor(F.col("_at") / width).alias("part")).agg(F.count("*").alias("n")).collect()}
    starts, total = [0], 0
    for at in range(int(max(sizes, default=0))):
        total += sizes.get(at, 0)
        starts.append(total)
    laid = laid.withColumn("_part", F.floor(F.col("_at") / width))
    laid = laid.withColumn(name, F.get(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("_part").cast("int")) + F.col("_at") % width)
    return (laid.withColumn(part, F.col("_part")) if part else laid).drop("_at", "_part")


def carried(laid: DataFrame, group: str, values: dict, number: str = "number", part: str = "part") -> DataFrame:
    """`laid` with, for each named value, its last one that is not null in the group's rows before; and `first_number`.

    `laid` is numbered by an order that starts with the group. Windows stay within a range; a group that goes on
    over several ranges is completed from one row for each range, so no task holds a group.
    """
    inside = Window.partitionBy(part, group)
    before = inside.orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    valued = laid.withColumns({f"_own_{k}": v for k, v in values.items()})
    ends = valued.groupBy(part, group).agg(F.min(number).alias("_least"), *[F.max_by(f"_own_{k}", F.when(F.col(f"_own_{k}").isNotNull(), F.col(number))).alias(f"_end_{k}") for k in values])
    longer = ends.groupBy(group).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(group).alias("_group"))
    ranges = Window.partitionBy(group).orderBy(part)
    ends = ends.join(longer, F.col(group).eqNullSafe(F.col("_group")), "left_semi")
    ends = ends.select(
        F.col(part).alias("_part"), F.col(group).alias("_of"), F.min("_least").over(Window.partitionBy(group)).alias("_start"),
        *[F.last(f"_end_{k}", ignorenulls=True).over(ranges.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_end_{k}") for k in values],
    )
    local = valued.withColumns({"first_number": F.min(number).over(inside)} | {k: F.last(f"_own_{k}", ignorenulls=True).over(before) for k in values})
    # groups of several ranges: at most two rows for each range
    joined = local.join(F.broadcast(ends), (F.col(part) == F.col("_part")) & F.col(group).eqNullSafe(F.col("_of")), "left")
    joined = joined.withColumns({"first_number": F.coalesce("_start", "first_number")} | {k: F.coalesce(k, f"_end_{k}") for k in values})
    return joined.select(*laid.columns, "first_number", *values)


def small_or_shuffled(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` marked for broadcast if it is counted to have at most `rows` narrow rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_hot(rows: DataFrame, values: DataFrame, key: str, hot: int = 1_000) -> DataFrame:
    """An inner join on `key`, which is unique in `values`, that no key of `rows` fills a task of.

    A small table of values is broadcast. Beyond that, keys that more than `hot` rows have are counted (before the shuffle, like any sum); if they are few enough to be
    broadcast, their rows meet their values where they are, and only the others are shuffled. Were they too many,
    none would be large against the whole, and all rows are shuffled.
    """
    if values.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        return rows.join(F.broadcast(values), key)
    keys = cut_lineage(rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select(key))
    if keys.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return rows.join(values, key)
    there = rows.join(F.broadcast(values.join(F.broadcast(keys), key, "left_semi")), key)
    rest = rows.join(F.broadcast(keys), key, "left_anti").join(values, key)
    return there.unionByName(rest)


def min_labels(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of (a, b): the least node of each connected component.

    Labels take the least label of their neighbours and then jump to their label's label, so the number
    of rounds grows with the logarithm of a component's width. Each round is written out.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = cut_lineage(both)
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "m").alias("label"), F.col("label").alias("was"))
        lower = cut_lineage(lower)
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = cut_lineage(join_hot(lower, jump, "label").select("node", F.col("up").alias("label"), "was"))
        labels = new.select("node", "label")
        if new.where("label <> was").limit(1).count() == 0:
            return labels
