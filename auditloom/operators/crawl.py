"""The crawl of a site as a fixpoint over stored answers: which urls a breadth-first walk admits, in which order, from where.

Nothing is fetched. Answers and links are tables; each round takes the admitted frontier's links, keeps of each new
target its first discovery, and admits in the order of discovery: the place of the linking page, then the place of
the link on it. Places are running totals over ranges within a site (`sized.running_total`), so a round orders no site in
one task, and a page budget is cut exactly: a target is admitted if the places before it leave room. Rounds end when no
target is new or no site has room. Each round is written out.

Tables, all keyed by graph (the site):

* seeds: graph, url, via, ord - the homepage first, then sitemap entries; of a repeated url the least ord counts;
* answers: graph, url, status, is_html, location (a redirect's target, null if there is none);
* links: graph, url, target, how, ord - crawlable targets that a page names, in page order;
* blocked: graph, url - urls that robots.txt forbids.

Defined cases: a url without an answer is admitted with a null status and leads nowhere; so is a blocked one, whose
answer is not looked at. Answers that repeat a url count once, the least. Links to the page itself are no edges. A null
graph is a site of its own nowhere: such rows are left out. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import bfs_depth, cut_lineage, written
from .sized import running_total


def crawl(seeds: DataFrame, answers: DataFrame, links: DataFrame, blocked: DataFrame, max_pages: int = 5_000) -> DataFrame:
    """(graph, url, place, round, via, found_on, status, is_html, location, robots_blocked) of the admitted urls of each site."""
    known = answers.where("graph IS NOT NULL AND url IS NOT NULL").groupBy("graph", "url").agg(F.min(F.struct("status", "is_html", "location")).alias("a"))
    known = cut_lineage(known.select("graph", "url", F.col("a.status").cast("int").alias("status"), F.coalesce("a.is_html", F.lit(False)).alias("is_html"), "a.location"))
    forbidden = blocked.select("graph", "url", F.lit(True).alias("forbidden")).distinct()
    onward = cut_lineage(links.where("graph IS NOT NULL AND target IS NOT NULL").select("graph", "url", "target", "how", F.col("ord").cast("long").alias("ord")))

    found = seeds.where("graph IS NOT NULL AND url IS NOT NULL").select("graph", "url", F.lit(0).cast("long").alias("at"), F.col("ord").cast("long").alias("ord"), "via", F.lit(None).cast("string").alias("found_on"))
    records, n = None, 0
    counts = found.select("graph").distinct().withColumn("taken", F.lit(0).cast("long"))
    while True:
        # the first discovery of each url that is not admitted yet
        first = found.groupBy("graph", "url").agg(F.min(F.struct("at", "ord", "via", "found_on")).alias("f")).select("graph", "url", "f.*")
        if records is not None:
            first = first.join(records.select("graph", "url"), ["graph", "url"], "left_anti")
        placed = running_total(first, "graph", [F.col("at").asc(), F.col("ord").asc(), F.col("url").asc()], F.lit(1), "before").join(counts, "graph")
        placed = placed.withColumn("place", F.col("taken") + F.col("before")).where(F.col("place") < max_pages)
        met = placed.join(known, ["graph", "url"], "left").join(forbidden, ["graph", "url"], "left")
        held = F.coalesce("forbidden", F.lit(False))
        new = written(
            met.select(
                "graph", "url", "place", F.lit(n).alias("round"), "via", "found_on", F.when(~held, F.col("status")).alias("status"),
                (~held & F.coalesce("is_html", F.lit(False)) & (F.col("status") == 200)).alias("is_html"), F.when(~held & F.col("status").between(300, 399), F.col("location")).alias("location"), held.alias("robots_blocked"),
            )
        )
        if new.limit(1).count() == 0:
            return records if records is not None else new
        records = new if records is None else written(records.unionByName(new))
        counts = written(records.groupBy("graph").agg(F.count("*").alias("taken")))
        pages = new.where("is_html").select("graph", "url", F.col("place").alias("at"))
        by_link = pages.join(onward, ["graph", "url"]).select("graph", F.col("target").alias("url"), "at", "ord", F.col("how").alias("via"), F.col("url").alias("found_on"))
        # a redirect's target is found where the redirecting url was found
        by_redirect = new.where("location IS NOT NULL").select("graph", F.col("location").alias("url"), F.col("place").alias("at"), F.lit(0).cast("long").alias("ord"), F.lit("redirect").alias("via"), "found_on")
        found, n = by_link.unionByName(by_redirect), n + 1


def crawl_edges(records: DataFrame, links: DataFrame) -> DataFrame:
    """(graph, src, dst): links in text and redirects of admitted urls, to other urls."""
    pages = records.where("is_html").select("graph", "url")
    named = links.where("how = 'link'").select("graph", "url", "target").join(pages, ["graph", "url"], "left_semi").select("graph", F.col("url").alias("src"), F.col("target").alias("dst"))
    moved = records.where("location IS NOT NULL").select("graph", F.col("url").alias("src"), F.col("location").alias("dst"))
    return named.unionByName(moved).where("src <> dst").distinct()


def crawl_facts(records: DataFrame, links: DataFrame, roots: DataFrame) -> DataFrame:
    """The records with depth (links from the site's root, null if none leads there), inlinks and sources.

    `sources` counts the admitted pages that name the url in any way; the target of a redirect inherits the page on
    which the redirecting url was found. roots: graph, node.
    """
    edges = crawl_edges(records, links)
    depth = bfs_depth(edges, roots).select("graph", F.col("node").alias("url"), "depth")
    inlinks = edges.groupBy("graph", F.col("dst").alias("url")).agg(F.count("*").alias("inlinks"))
    pages = records.where("is_html").select("graph", "url")
    named = links.select("graph", "url", "target").join(pages, ["graph", "url"], "left_semi").select("graph", F.col("target").alias("url"), F.col("url").alias("source"))
    inherited = records.where("location IS NOT NULL AND found_on IS NOT NULL").select("graph", F.col("location").alias("url"), F.col("found_on").alias("source"))
    sources = named.unionByName(inherited).where("url <> source").distinct().groupBy("graph", "url").agg(F.count("*").alias("sources"))
    out = records
    for more in (depth, inlinks, sources):
        out = out.join(more, ["graph", "url"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("inlinks", "sources")})


def truncated_sites(records: DataFrame, links: DataFrame) -> DataFrame:
    """(graph, left) of sites whose budget left out urls that admitted ones name, and how many."""
    edges = crawl_edges(records, links).select("graph", F.col("dst").alias("url"))
    named = links.join(records.where("is_html").select("graph", "url"), ["graph", "url"], "left_semi").select("graph", F.col("target").alias("url"))
    left = edges.union(named).distinct().join(records.select("graph", "url"), ["graph", "url"], "left_anti")
    return left.groupBy("graph").agg(F.count("*").alias("left"))
