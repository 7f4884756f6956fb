"""Link graphs: depth, redirects, in-links. Iterations keep frontiers as DataFrames and cut their lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _shared_folder(df: DataFrame) -> str:
    """The session's shared checkpoint folder (spark.checkpoint.dir), set as the folder of checkpoints.

    Where it is unset, a local session (one machine, as in tests) gets a folder of its own; a cluster gets an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and re.fullmatch(r"local(\[.*\])?", context.master):
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        if folder is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` checkpointed in the session's shared folder."""
    _shared_folder(df)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the session's shared folder: its plan is that of a file, whatever made it."""
    path = f"{_shared_folder(df)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def bfs_depth(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(graph, node, depth): fewest links from a root, per graph; edges (graph, src, dst), roots (graph, node).

    Each round expands the last frontier only and drops what has been seen; it ends when nothing is new, or at
    `max_depth` if one is given. Every 16 rounds the nodes seen are written as one table, so plans stay short.
    """
    links = cut_lineage(edges.select("graph", "src", "dst").where("src <> dst").distinct())
    seen = cut_lineage(roots.select("graph", "node").distinct().withColumn("depth", F.lit(0).cast("long")))
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.select("graph", F.col("node").alias("src")).join(links, ["graph", "src"]).select("graph", F.col("dst").alias("node")).distinct()
        new = cut_lineage(step.join(seen, ["graph", "node"], "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        if new.limit(1).count() == 0:
            break
        seen, frontier = seen.union(new), new
        if depth % 16 == 0:
            seen = cut_lineage(seen)
    return seen


def all_depths(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(graph, node, depth, linked) of every node of (graph, node), of every end of a link and every root.

    The depth is null if no path leads there from a root; `linked` tells whether another node links to it.
    """
    links = cut_lineage(edges.select("graph", "src", "dst").where("src <> dst").distinct())
    ends = links.select("graph", F.col("src").alias("node"), F.lit(False).alias("linked")).union(links.select("graph", "dst", F.lit(True)))
    known = nodes.select("graph", "node", F.lit(False).alias("linked")).union(roots.select("graph", "node", F.lit(False))).union(ends)
    known = known.groupBy("graph", "node").agg(F.bool_or("linked").alias("linked"))
    return known.join(bfs_depth(links, roots), ["graph", "node"], "left").select("graph", "node", "depth", "linked")


def redirect_closure(hops: DataFrame, max_hops: int = 10) -> DataFrame:
    """(url, final_url, hops, is_loop) of every source of (url, location): the chain followed to its end.

    A chain ends at a url that does not redirect. One that would come back to a url it has been at stops before
    that, and one of `max_hops` redirects stops there; both are loops. Of a url with several locations the least counts.
    Each round takes only the chains that go on, and is written out.
    """
    step = cut_lineage(hops.groupBy(F.col("url").alias("at")).agg(F.min("location").alias("onward")).where("at IS NOT NULL AND onward IS NOT NULL"))
    going = step.select(F.col("at").alias("url"), "at", F.array("at").alias("seen"))
    ended = []
    for n in range(max_hops + 1):
        met = going.join(step, "at", "left")
        back = F.coalesce(F.array_contains("seen", F.col("onward")), F.lit(False))
        met = cut_lineage(met.select("url", "at", "seen", "onward", (back | F.lit(n >= max_hops)).alias("is_loop")))
        ended.append(met.where("is_loop OR onward IS NULL").select("url", F.col("at").alias("final_url"), F.lit(n).cast("long").alias("hops"), "is_loop"))
        going = met.where("NOT is_loop AND onward IS NOT NULL").select("url", F.col("onward").alias("at"), F.array_append("seen", F.col("onward")).alias("seen"))
        if n == max_hops or going.limit(1).count() == 0:
            break
    out = ended[0]
    for part in ended[1:]:
        out = out.unionByName(part)
    return out


def hub_coverage(nodes: DataFrame, edges: DataFrame, hubs: DataFrame, examples: int = 15) -> DataFrame:
    """(graph, hub, prefix, pages, linked, missing, examples) of every hub that is a node and has nodes below its prefix.

    nodes (graph, node), edges (graph, src, dst), hubs (graph, hub, prefix); a prefix ends with a slash. `pages` are
    the nodes below the prefix without the hub, `linked` those that the hub links to, `examples` the first of the others.
    A node meets hubs by equality with each of its own prefixes (as many as it has slashes), never by comparing pairs.
    """
    parts = F.split("node", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    known = nodes.select("graph", "node").where("graph IS NOT NULL AND node IS NOT NULL").distinct()
    asked = hubs.select("graph", "hub", "prefix").distinct().join(known.select("graph", F.col("node").alias("hub")), ["graph", "hub"], "left_semi")
    below = known.where(F.size(parts) > 1).select("graph", "node", F.explode(F.array_distinct(above)).alias("prefix")).join(asked, ["graph", "prefix"]).where("node <> hub")
    own = edges.select("graph", F.col("src").alias("hub"), F.col("dst").alias("node"), F.lit(True).alias("linked")).distinct()
    met = below.join(own, ["graph", "hub", "node"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    counts = met.groupBy("graph", "hub", "prefix").agg(F.count("*").alias("pages"), F.count_if("linked").alias("linked"), F.count_if(~F.col("linked")).alias("missing"))
    # a limit on the row number is taken in every task before the shuffle
    first = met.where("NOT linked").withColumn("_nth", F.row_number().over(Window.partitionBy("graph", "hub", "prefix").orderBy("node"))).where(F.col("_nth") <= examples)
    named = first.groupBy("graph", "hub", "prefix").agg(F.sort_array(F.collect_list("node")).alias("examples"))
    return counts.join(named, ["graph", "hub", "prefix"], "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))


def in_degree(edges: DataFrame) -> DataFrame:
    """(graph, node, inlinks): distinct linking pages, self-links left out."""
    return edges.where("src <> dst").groupBy("graph", F.col("dst").alias("node")).agg(F.count_distinct("src").alias("inlinks"))


def unlinked(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes (graph, node) that no other node links to."""
    targets = edges.where("src <> dst").select("graph", F.col("dst").alias("node")).distinct()
    return nodes.join(targets, ["graph", "node"], "left_anti")
