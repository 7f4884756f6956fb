"""Facts of a whole run: which pages count, how they are reached, how reports cover them, and orders of the results.

Counts of a site are one row from a partial aggregation; nothing is ordered but what a report shows. Defined cases: an
empty table gives no rows or a row of zeros, and null marks count as not set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import classify as C
from auditloom.functions import urls as U

from .element_rules import COLUMNS
from .rules import SITE_WIDE, Rule, evaluate

#: Order in which a checklist shows its results.
STATUSES = ("FAIL", "WARN", "SKIP", "HUMAN", "PASS")


def site_pages(records: DataFrame) -> DataFrame:
    """Crawl records that are audited as pages, in order: those of the sitemap, then the others as they were found (ord).

    HTML with status 200; outside the sitemap a page that names another address as its own is a declared duplicate.
    """
    page = F.coalesce("is_html", F.lit(False)) & (F.col("status") == 200)
    listed = F.coalesce("in_sitemap", F.lit(False))
    own = (F.coalesce("canonical", F.lit("")) == "") | (U.norm(F.col("canonical")) == U.norm(F.col("url")))
    return records.where(page & (listed | own)).orderBy(F.desc(listed), "ord")


def answers(records: DataFrame, n: int = 5) -> DataFrame:
    """(answer, n): the most frequent statuses, or errors where there is none; what is said when no page was found."""
    answer = F.coalesce(F.nullif("status", F.lit(0)).cast("string"), F.nullif("error", F.lit("")), F.lit("?"))
    return records.groupBy(answer.alias("answer")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "answer").limit(n)


def script_only(links: DataFrame, script_links: DataFrame) -> DataFrame:
    """(url) of targets (source, target) that scripts lead to and no link of another page does."""
    linked = links.where("source <> target").select("target").distinct()
    return script_links.select("target").distinct().join(linked, "target", "left_anti").select(F.col("target").alias("url"))


def all_edges(crawled: DataFrame, found: DataFrame) -> DataFrame:
    """(source, target): edges of the crawl and those of the stored pages, each once, in their equality form."""
    both = crawled.select("source", "target").unionByName(found.select("source", "target"))
    return both.select(U.norm(F.col("source")).alias("source"), U.norm(F.col("target")).alias("target")).distinct()


def seeds(*parts: DataFrame) -> DataFrame:
    """(url): where a crawl starts, from lists of (url) in order of rank; of addresses that are equal the first one stays."""
    ranked = [p.select("url", F.lit(i).alias("part")) for i, p in enumerate(parts)]
    rows = ranked[0]
    for p in ranked[1:]:
        rows = rows.unionByName(p)
    return rows.where("url IS NOT NULL").groupBy(U.norm(F.col("url")).alias("key")).agg(F.min(F.struct("part", "url")).alias("m")).select("m.url")


def clean_pages(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """(pages, clean): all pages, and those without a critical or important issue."""
    bad = issues.where(F.col("severity").isin("Critical", "Important")).select("url").distinct().withColumn("bad", F.lit(True))
    return pages.select("url").join(bad, "url", "left").agg(F.count("*").alias("pages"), F.count_if(F.col("bad").isNull()).alias("clean"))


def dominant_image(pages: DataFrame, most: float = 0.5, least: int = 5) -> DataFrame:
    """A site-wide issue if one share image (og_image) stands on more than half of the pages, of more than five."""
    counts = pages.groupBy("og_image").agg(F.count("*").alias("n"))
    image = F.when(F.coalesce("og_image", F.lit("")) != "", F.struct("n", "og_image"))
    top = counts.agg(F.sum("n").alias("total"), F.max(image).alias("m")).select("total", "m.n", "m.og_image", F.lit(SITE_WIDE).alias("url"))
    share = (F.col("total") > least) & (F.col("n") / F.nullif("total", F.lit(0)) > most)
    current = F.concat("n", F.lit(" of "), "total", F.lit(" pages"))
    return evaluate(top, [Rule("Optimization", "Open Graph", "Same share image on most pages", share, current, F.col("og_image"))]).select(*COLUMNS)


def passing(ratings: DataFrame) -> DataFrame:
    """(pages, passing) of (url, lcp, cls, inp) ratings: the first two are good, the last is good or was not measured."""
    good = (F.col("lcp") == "Good") & (F.col("cls") == "Good") & F.col("inp").isin("Good", "n/a")
    return ratings.agg(F.count("*").alias("pages"), F.count_if(good).alias("passing"))


def category_averages(scores: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(category, average) of a column of scores each, and of all of them together (Overall), rounded to one digit."""
    long = scores.select(F.explode(F.array(*[F.struct(F.lit(n).alias("category"), F.col(n).cast("double").alias("v")) for n in names])).alias("x")).select("x.*")
    each = long.where("v IS NOT NULL").groupBy("category").agg(F.round(F.avg("v"), 1).alias("average"))
    whole = each.agg(F.round(F.avg("average"), 1).alias("average")).where("average IS NOT NULL")
    return each.unionByName(whole.select(F.lit("Overall").alias("category"), "average"))


#: Where the name of an item may stand, in order.
_NAMES = ("url", "source", "label", "groupLabel", "description", "entity")
_NODE = "selector string, snippet string, nodeLabel string"
_ITEM = f"node struct<{_NODE.replace(' string', ': string')}>, type string, {_NODE}, " + ", ".join(f"{n} string" for n in _NAMES)
_ITEMS = f"struct<items: array<struct<{_ITEM}, subItems struct<items: array<struct<{_ITEM}>>>>>>"


def _label(item: Column) -> Column:
    filled = lambda c: F.nullif(c, F.lit(""))
    node = lambda n: F.coalesce(filled(n["selector"]), filled(n["snippet"]), filled(n["nodeLabel"]), F.lit(""))
    inner = lambda v: F.coalesce(filled(F.get_json_object(v, "$.url")), F.get_json_object(v, "$.text"))
    plain = F.coalesce(*[filled(F.when(F.startswith(item[n], F.lit("{")), inner(item[n])).otherwise(item[n])) for n in _NAMES], F.lit(""))
    return F.left(F.when(item["node"].isNotNull(), node(item["node"])).when(item["type"] == "node", node(item)).otherwise(plain), F.lit(150))


def failing_items(details: Column, most: int = 5) -> Column:
    """struct(labels, total) of an audit's details (JSON): the first `most` different names of its items, and their number."""
    items = F.coalesce(F.from_json(details, _ITEMS)["items"], F.array().cast(f"array<struct<{_ITEM}, subItems struct<items: array<struct<{_ITEM}>>>>>"))
    below = lambda i: F.coalesce(_label(F.get(i["subItems"]["items"], 0)), F.lit(""))
    name = lambda i: F.coalesce(F.nullif(_label(i), F.lit("")), below(i))
    labels = F.array_distinct(F.array_remove(F.transform(items, name), ""))
    return F.struct(F.slice(labels, 1, most).alias("labels"), F.size(items).alias("total"))


def partial_coverage(reports: DataFrame, html_pages: int, whole: tuple[str, ...] = ("28_repo",)) -> DataFrame:
    """(key, note) of reports (key, pages_checked) that saw fewer than nine tenths of the pages of the crawl."""
    n = F.col("pages_checked")
    few = (n > 0) & (n < 0.9 * html_pages) & ~F.col("key").isin(*whole)
    return reports.where(few).select("key", F.concat("key", F.lit(": "), n, F.lit(f" of {html_pages} pages")).alias("note"))


def servers(reports: DataFrame) -> DataFrame:
    """(server, servers, mixed): the server that most reports (server) are about, how many there are, and whether more than one."""
    counts = reports.groupBy(F.coalesce("server", F.lit("")).alias("server")).agg(F.count("*").alias("n"))
    top = F.max(F.struct("n", "server"))
    return counts.agg(top.alias("m"), F.count("*").alias("servers")).where("servers > 0").select("m.server", "servers", (F.col("servers") > 1).alias("mixed"))


def owner_notes(results: DataFrame, owners: tuple[str, ...]) -> DataFrame:
    """(id, note) of failed and warned checks (id, title, result, status, owner, evidence) of some owners, with the first evidence."""
    rows = results.where(F.col("status").isin("FAIL", "WARN") & F.col("owner").isin(*owners))
    first = F.get("evidence", 0)
    note = F.concat(F.lit("- "), "id", F.lit(" "), "title", F.lit(": "), "result", F.when(first.isNotNull(), F.concat(F.lit(" e.g. "), F.left(first, F.lit(100)))).otherwise(""))
    return rows.orderBy(F.col("status") != "FAIL", "id").select("id", note.alias("note"))


def name_variants(names: DataFrame, company: str) -> DataFrame:
    """(source, name, pages) of names (source, name, page) that neither hold the firm's name nor are held by it."""
    own, name = C.business_name(F.lit(company)), C.business_name(F.col("name"))
    other = (name != "") & ~F.contains(name, own) & ~F.contains(own, name)
    return names.where((own != "") & other).groupBy("source", "name").agg(F.count_distinct("page").alias("pages"))


def shared_blocks(issues: DataFrame, places: DataFrame, shared: int) -> DataFrame:
    """Issues of texts (text, ...) at every place (text, url, ord) of the text; a text of `shared` pages or more at its first place only."""
    each = places.groupBy("text", "url").agg(F.min("ord").alias("ord"))
    pages = each.groupBy("text").agg(F.count("url").alias("n_pages"))
    # of a text on very many pages no more than its first ones are shuffled; one of them may have no url
    nearest = F.row_number().over(Window.partitionBy("text").orderBy("ord", "url"))
    first = each.withColumn("_rank", nearest).where(F.col("_rank") <= shared + 1)
    first = first.groupBy("text").agg(F.sort_array(F.collect_list(F.struct("ord", "url"))).alias("_first"))
    met = issues.join(pages, "text").join(first, "text")
    shown = F.when(F.col("n_pages") >= shared, F.slice("_first", 1, 1)).otherwise(F.col("_first"))
    rows = met.withColumn("_place", F.explode(shown))
    return rows.select(*issues.columns, "n_pages", "_place.url", "_place.ord")


def master_order() -> list[Column]:
    """Order of addresses in the master report: what is site-wide last, then by grave issues, most first."""
    return [F.col("url") == SITE_WIDE, F.desc("critical"), F.desc("important"), F.col("url")]


def status_rank(status: Column) -> Column:
    """The place of a check's status in the order of the checklist; unknown ones last."""
    out = F.lit(len(STATUSES))
    for n, name in enumerate(STATUSES):
        out = F.when(status == name, n).otherwise(out)
    return out


def missing_reports(expected: DataFrame, reports: DataFrame) -> DataFrame:
    """(key) of reports that should be there and are not."""
    return expected.select("key").distinct().join(reports.select("key").distinct(), "key", "left_anti")
