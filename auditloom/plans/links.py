"""Link graph queries. A site is a bare host; its nodes are paths, whether or not a page is stored for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions import html as H
from auditloom.functions import urls as U
from auditloom.operators import graph

from .onpage import FACTS_SQL, URL_SQL
from .registry import query, table

#: Link texts that say nothing about the target.
GENERIC_ANCHORS = ("click here", "here", "read more", "more", "learn more", "link", "this", "view", "details", "go", "view more", "see more", "continue", "click")
MAX_LINKS, MIN_INTERNAL, MAX_DEPTH = 150, 3, 3

#: A link's start up to its href: attributes in any quotation marks; `data-href` is another attribute.
HREF_SQL = r"""'(?is)<a\s(?:[^>]*?[\s"''])??href\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))"""
LINKS_SQL = "WITH " + FACTS_SQL + "," + URL_SQL + rf""", a AS (
  SELECT page_id, url, unnest(tags) AS tag, generate_subscripts(tags, 1) AS nth
  FROM (SELECT page_id, url, regexp_extract_all(body, {HREF_SQL}[^>]*>.*?</a>') AS tags FROM facts)
), hrefs AS (
  SELECT *, regexp_extract(tag, {HREF_SQL}', 1) || regexp_extract(tag, {HREF_SQL}', 2) || regexp_extract(tag, {HREF_SQL}', 3) AS raw FROM a
""" + r"""), links AS (
  SELECT page_id, url, nth, replace(replace(replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS href,
    trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(tag, '<[^>]*>', ' ', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g')) AS label
  FROM hrefs
), edges AS (
  SELECT DISTINCT bare_host AS graph, path AS src, CASE WHEN regexp_replace(dst, '/+$', '') = '' THEN '/' ELSE regexp_replace(dst, '/+$', '') END AS dst
  FROM (SELECT *, regexp_extract(CASE WHEN href LIKE '/%' THEN href WHEN href = '' OR href LIKE '#%' OR href LIKE '?%' THEN raw_path ELSE regexp_replace(raw_path, '[^/]*$', '') || href END, '^([^?#]*)', 1) AS dst
    FROM links JOIN urls USING (page_id) WHERE href NOT LIKE '//%' AND NOT regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:'))
)"""


def links(spark, sf_dir):
    """(page_id, url, href, label) of every link of every page."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", F.explode(H.anchors(F.col("html"))).alias("a")).select("page_id", "url", "a.href", "a.label")


def edges(spark, sf_dir):
    """(graph, src, dst) of links within a site."""
    rows = links(spark, sf_dir).withColumn("full", U.resolve(F.col("url"), F.col("href")))
    rows = rows.where(U.host(F.col("full")) == U.host(F.col("url")))
    return rows.select(U.bare_host(F.col("url")).alias("graph"), U.path(F.col("url")).alias("src"), U.path(F.col("full")).alias("dst")).distinct()


@query(LINKS_SQL + " SELECT url, href, label AS anchor FROM links")
def page_links(spark, sf_dir):
    return links(spark, sf_dir).select("url", "href", F.col("label").alias("anchor"))


@query(LINKS_SQL + r""", n AS (SELECT url, count(*)::BIGINT AS links, count(DISTINCT href)::BIGINT AS unique_targets FROM links GROUP BY url)
SELECT url, links, unique_targets, CASE WHEN links > 150 THEN 'Excessive links on page' WHEN unique_targets < 3 THEN 'Very few internal links' END AS problem FROM n""")
def link_counts(spark, sf_dir):
    counts = links(spark, sf_dir).groupBy("url").agg(F.count("*").alias("links"), F.count_distinct("href").alias("unique_targets"))
    return counts.withColumn("problem", F.when(F.col("links") > MAX_LINKS, "Excessive links on page").when(F.col("unique_targets") < MIN_INTERNAL, "Very few internal links"))


@query(LINKS_SQL + " SELECT graph AS host, dst AS target, count(DISTINCT src)::BIGINT AS inlinks FROM edges WHERE src <> dst GROUP BY 1, 2")
def link_indegree(spark, sf_dir):
    return graph.in_degree(edges(spark, sf_dir)).select(F.col("graph").alias("host"), F.col("node").alias("target"), "inlinks")


@query(LINKS_SQL + r""" SELECT graph AS host, dst AS target, count(DISTINCT src)::BIGINT AS sources FROM edges e
WHERE NOT EXISTS (SELECT 1 FROM urls u WHERE u.bare_host = e.graph AND u.path = e.dst) GROUP BY 1, 2""")
def dangling_targets(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(U.bare_host(F.col("url")).alias("graph"), U.path(F.col("url")).alias("dst")).distinct()
    missing = edges(spark, sf_dir).join(pages, ["graph", "dst"], "left_anti")
    return missing.groupBy(F.col("graph").alias("host"), F.col("dst").alias("target")).agg(F.count_distinct("src").alias("sources"))


#: A hub laid over each section: the least path with a first segment stands for the page that lists the others.
HUBS_SQL = r""", nodes AS (SELECT DISTINCT bare_host AS graph, path AS node FROM urls), sections AS (
  SELECT graph, min(node) AS hub, '/' || string_split(node, '/')[2] || '/' AS prefix FROM nodes WHERE len(string_split(node, '/')) > 2 GROUP BY 1, 3
), hubs AS (SELECT * FROM sections UNION SELECT graph, node, node || '/' FROM nodes WHERE node <> '/')"""


@query(LINKS_SQL + HUBS_SQL + r""", met AS (
  SELECT h.graph, h.hub, h.prefix, n.node, EXISTS (SELECT 1 FROM edges e WHERE e.graph = h.graph AND e.src = h.hub AND e.dst = n.node) AS linked
  FROM hubs h JOIN nodes n ON n.graph = h.graph AND starts_with(n.node, h.prefix) AND n.node <> h.hub
) SELECT graph AS host, hub, prefix, count(*)::BIGINT AS pages, count(*) FILTER (linked)::BIGINT AS linked, count(*) FILTER (NOT linked)::BIGINT AS missing,
  coalesce(array_to_string((list(node ORDER BY node) FILTER (NOT linked))[1:15], ', '), '') AS examples FROM met GROUP BY 1, 2, 3""")
def hub_coverage(spark, sf_dir):
    """Which of the pages below a hub the hub itself links to. Every page is the hub of the paths below it; the first page
    of a section is laid out as the section's hub."""
    one_way = edges(spark, sf_dir)
    nodes = table(spark, sf_dir, "pages").select(U.bare_host(F.col("url")).alias("graph"), U.path(F.col("url")).alias("node")).distinct()
    parts = F.split("node", "/")
    sections = nodes.where(F.size(parts) > 2).groupBy("graph", F.concat(F.lit("/"), F.get(parts, 1), F.lit("/")).alias("prefix")).agg(F.min("node").alias("hub"))
    own = nodes.where("node <> '/'").select("graph", F.concat("node", F.lit("/")).alias("prefix"), F.col("node").alias("hub"))
    rows = graph.hub_coverage(nodes, one_way, sections.unionByName(own).distinct())
    return rows.select(F.col("graph").alias("host"), "hub", "prefix", "pages", "linked", "missing", F.array_join("examples", ", ").alias("examples"))


@query(LINKS_SQL + r""" SELECT url FROM urls u WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph = u.bare_host AND e.dst = u.path AND e.src <> e.dst)""")
def orphan_pages(spark, sf_dir):
    nodes = table(spark, sf_dir, "pages").select("url", U.bare_host(F.col("url")).alias("graph"), U.path(F.col("url")).alias("node"))
    return graph.unlinked(nodes, edges(spark, sf_dir)).select("url")


ROOTS_SQL = r""", roots AS (SELECT graph, min(node) AS node FROM (SELECT bare_host AS graph, path AS node FROM urls UNION SELECT graph, '/' FROM edges WHERE src = '/' OR dst = '/') GROUP BY 1)"""


def _roots(nodes, one_way):
    """Each site's "/", or its first path if it has no "/"."""
    home = one_way.where("src = '/' OR dst = '/'").select("graph", F.lit("/").alias("node"))
    return nodes.union(home).groupBy("graph").agg(F.min("node").alias("node"))


@query(LINKS_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + ROOTS_SQL + r""", walk(graph, node, depth) USING KEY (graph, node) AS (
  SELECT graph, node, 0 FROM roots
  UNION SELECT e.graph, e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.graph = w.graph AND e.src = w.node AND e.src <> e.dst
    WHERE NOT EXISTS (SELECT 1 FROM recurring.walk r WHERE r.graph = e.graph AND r.node = e.dst)
) SELECT graph AS host, node, depth::BIGINT AS depth FROM walk""")
def bfs_depth(spark, sf_dir):
    """Clicks from each site's root to every path that links lead to, one way, to the end of the walk."""
    one_way = edges(spark, sf_dir)
    nodes = table(spark, sf_dir, "pages").select(U.bare_host(F.col("url")).alias("graph"), U.path(F.col("url")).alias("node")).distinct()
    return graph.bfs_depth(one_way, _roots(nodes, one_way)).select(F.col("graph").alias("host"), "node", "depth")


@query()
def click_depth(spark, sf_dir):
    """Clicks to every page from its site's "/", or from the site's first path if it has no "/"; null if none lead there.

    The walk follows links one way to its end, and MAX_DEPTH is a threshold of the report only. Its length is that of
    the longest path, so there is no SQL; the tests compare it with brute force.
    """
    one_way = edges(spark, sf_dir)
    nodes = table(spark, sf_dir, "pages").select(U.bare_host(F.col("url")).alias("graph"), U.path(F.col("url")).alias("node")).distinct()
    unreached = F.when(F.col("linked"), "Not reachable from homepage by links").otherwise("Orphan page")
    problem = F.when(F.col("depth").isNull(), unreached).when(F.col("depth") > MAX_DEPTH, "Page too deep")
    return graph.all_depths(nodes, one_way, _roots(nodes, one_way)).select(F.col("graph").alias("host"), "node", "depth", problem.alias("problem"))


@query(r"""WITH RECURSIVE k AS (SELECT c_custkey AS k, c_custkey % 41 AS m FROM customer), h AS (
  SELECT 'u' || k AS url, 'u' || CASE WHEN m < 12 OR m IN (20, 21, 30, 31) THEN k + 1 WHEN m = 22 THEN k - 1 ELSE k END AS location FROM k WHERE m < 12 OR m IN (20, 21, 22, 25, 30, 31)
), w AS (
  SELECT url, url AS here, 0 AS hops, [url] AS seen, false AS is_loop FROM h
  UNION ALL SELECT w.url, CASE WHEN list_contains(seen, location) THEN here ELSE location END, CASE WHEN list_contains(seen, location) THEN hops ELSE hops + 1 END, list_append(seen, location),
    list_contains(seen, location) OR hops + 1 >= 10 FROM w JOIN h ON h.url = w.here WHERE NOT w.is_loop
)
SELECT url, max_by(here, (hops, is_loop)) AS final_url, max(hops)::BIGINT AS hops, max(is_loop::INTEGER)::BOOLEAN AS is_loop FROM w GROUP BY url""")
def redirect_closure(spark, sf_dir):
    """Redirects laid over customer keys: chains of 12, of two, tails into a loop of two, and urls that lead to themselves."""
    k = F.col("c_custkey")
    m = k % 41
    target = F.when((m < 12) | m.isin(20, 21, 30, 31), k + 1).when(m == 22, k - 1).otherwise(k)
    hops = table(spark, sf_dir, "customer").where((m < 12) | m.isin(20, 21, 22, 25, 30, 31)).select(F.concat(F.lit("u"), k).alias("url"), F.concat(F.lit("u"), target).alias("location"))
    return graph.redirect_closure(hops)


@query(LINKS_SQL + " SELECT url, href, label AS anchor, trim(lower(label), ' .→›»>') IN (" + ", ".join(f"'{a}'" for a in GENERIC_ANCHORS) + ") AS generic, label = '' AS unnamed FROM links")
def generic_anchors(spark, sf_dir):
    """Every link, with whether its text says nothing about the target, or is missing."""
    bare = F.regexp_replace(F.lower("label"), r"^[ .→›»>]+|[ .→›»>]+$", "")
    return links(spark, sf_dir).select("url", "href", F.col("label").alias("anchor"), bare.isin(*GENERIC_ANCHORS).alias("generic"), (F.col("label") == "").alias("unnamed"))


@query(LINKS_SQL + r""", f AS (SELECT *, row_number() OVER (PARTITION BY url, href ORDER BY nth, label) AS rn FROM links) SELECT url, href, label AS anchor FROM f WHERE rn = 1""")
def first_source_label(spark, sf_dir):
    """The label of the first link of each page to each target, by a partial minimum of (place, label)."""
    pages = table(spark, sf_dir, "pages")
    rows = pages.select("url", F.posexplode(H.anchors(F.col("html"))).alias("at", "a"))
    first = rows.groupBy("url", F.col("a.href").alias("href")).agg(F.min(F.struct("at", F.col("a.label").alias("label"))).alias("f"))
    return first.select("url", "href", F.col("f.label").alias("anchor"))


#: The start of an element that loads something, or sends a form, over plain http, in any quotation marks.
LOADED = r"""(?is)<(script|link|img|iframe|source|video|audio|form)\s(?:[^>]*?[\s"'])??(?:src|href|action)\s*=\s*(?:"\s*(http://[^"]*)"|'\s*(http://[^']*)'|(http://[^\s"'>]+))"""
LOADED_SQL = "'" + LOADED.replace("'", "''") + "'"


@query(f"""WITH t AS (SELECT url, unnest(regexp_extract_all(regexp_replace(coalesce(html, ''), '<!--.*?-->', ' ', 'gis'), {LOADED_SQL})) AS tag FROM pages WHERE url LIKE 'https://%')
SELECT url, lower(regexp_extract(tag, {LOADED_SQL}, 1)) AS tag, regexp_extract(tag, {LOADED_SQL}, 2) || regexp_extract(tag, {LOADED_SQL}, 3) || regexp_extract(tag, {LOADED_SQL}, 4) AS src FROM t""")
def mixed_content(spark, sf_dir):
    """What encrypted pages load, or send forms to, over plain http. Comments do not count."""
    shown = F.regexp_replace(F.coalesce("html", F.lit("")), "(?is)<!--.*?-->", " ")
    rows = table(spark, sf_dir, "pages").where(F.col("url").startswith("https://")).select("url", F.explode(F.regexp_extract_all(shown, F.lit(LOADED), F.lit(0))).alias("t"))
    return rows.select("url", F.lower(F.regexp_extract("t", LOADED, 1)).alias("tag"), F.concat(*[F.regexp_extract("t", LOADED, n) for n in (2, 3, 4)]).alias("src"))


@query("WITH " + URL_SQL + r""", l AS (SELECT DISTINCT regexp_replace(path, '^/[a-z]{2}/', '/x/') AS k FROM urls WHERE bare_host LIKE '%.com'),
d AS (SELECT DISTINCT regexp_replace(path, '^/[a-z]{2}/', '/x/') AS k FROM urls WHERE bare_host NOT LIKE '%.com')
SELECT coalesce(l.k, d.k) AS path, CASE WHEN d.k IS NULL THEN 'live only' WHEN l.k IS NULL THEN 'dev only' ELSE 'both' END AS found FROM l FULL JOIN d ON l.k = d.k""")
def live_vs_dev(spark, sf_dir):
    """Pages of two servers paired on their path, the language segment masked; .com stands for live."""
    rows = table(spark, sf_dir, "pages").select(U.bare_host(F.col("url")).endswith(".com").alias("live"), F.regexp_replace(U.path(F.col("url")), "^/[a-z]{2}/", "/x/").alias("path"))
    sides = rows.groupBy("path").agg(F.bool_or("live").alias("live"), F.bool_or(~F.col("live")).alias("dev"))
    return sides.select("path", F.when(~F.col("dev"), "live only").when(~F.col("live"), "dev only").otherwise("both").alias("found"))
