"""What pages load, and the files behind it: bytes by kind, third parties, alternative texts, fonts, feeds, manifests.

Inputs are collected facts (a row for each use, probe or fetched file) or the element table. Counts are partial before
the shuffle, and lists of examples are cut to their first rows by rank before they are gathered.

Defined cases: null sizes count as zero, an address without a probe is left out of the roll-up by host, probes that
repeat an address count once (the greatest status in alphabetical order), and a file without a body has no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import classify as C
from auditloom.functions import urls as U

from .element_rules import COLUMNS, _attr, _page
from .metrics import top_per_group
from .rules import SITE_WIDE, Rule, evaluate

KINDS = ("js", "css", "img", "font", "other")
#: Outcomes of a probe that count as failing, with the issue each raises.
FAILING = {"Error": "Third-party URL broken", "Timeout": "Third-party URL timeout", "SSL Error": "Third-party URL SSL error"}
#: Kinds of use without which a page breaks.
VITAL = ("Script", "Stylesheet", "Iframe")
#: What a web manifest should hold, and the icons it should name.
MANIFEST_KEYS, MANIFEST_ICONS = ("name", "short_name", "start_url", "display", "theme_color", "background_color"), ("192x192", "512x512")
#: Hosts that a published feed should not name.
FEED_DEV = r"localhost|127\.0\.0\.1|vercel\.app|staging"


def bytes_by_kind(resources: DataFrame) -> DataFrame:
    """(page, js, css, img, font, other, total) of (page, url, type, size, body): sent bytes, or those of the body if none were sent."""
    size = F.coalesce(F.nullif("size", F.lit(0)), "body", F.lit(0)).cast("long")
    rows = resources.select("page", C.resource_kind(F.col("type"), F.col("url")).alias("kind"), size.alias("bytes"))
    return rows.groupBy("page").agg(*[F.sum(F.when(F.col("kind") == k, F.col("bytes")).otherwise(0)).alias(k) for k in KINDS], F.sum("bytes").alias("total"))


def _probed(uses: DataFrame, probes: DataFrame) -> DataFrame:
    once = probes.groupBy("url").agg(F.max(F.struct("status", "code", "final", "hops", "error")).alias("p")).select("url", "p.*")
    return uses.select("page", "url", "kind").join(once, "url").withColumn("host", U.host(F.col("url")))


def third_party_domains(uses: DataFrame, probes: DataFrame, most: int = 20) -> DataFrame:
    """(host, uses, pages, failing, first_pages, first_urls): every use counted, the first `most` pages and addresses named.

    uses: page, url, kind; probes: url, status, code, final, hops, error.
    """
    met = _probed(uses, probes)
    counts = met.groupBy("host").agg(F.count("*").alias("uses"), F.count_distinct("page").alias("pages"), F.count_if(F.col("status").isin(*FAILING)).alias("failing"))

    def first(value: str) -> DataFrame:
        top = top_per_group(met.select("host", value).distinct(), "host", [F.col(value)], most)
        return top.groupBy("host").agg(F.array_sort(F.collect_list(value)).alias(f"first_{value}s"))

    return counts.join(first("page"), "host").join(first("url"), "host")


def third_party_rules(uses: DataFrame, probes: DataFrame) -> DataFrame:
    """Issues of every page that uses a failing, redirecting or insecure address of another host."""
    status, vital = F.col("status"), F.col("kind").isin(*VITAL)
    current = F.when(F.col("code") > 0, F.concat(F.lit("HTTP "), "code")).otherwise(F.left(F.coalesce(F.nullif("error", F.lit("")), "status"), F.lit(200)))
    element = F.left("url", F.lit(250))
    insecure = F.startswith("url", F.lit("http://")) & F.startswith("page", F.lit("https://"))
    rules = []
    for outcome, issue in FAILING.items():
        grave = vital & F.lit(outcome != "Timeout")
        rules += [Rule("Critical", "Third party", issue, (status == outcome) & grave, current, element), Rule("Important", "Third party", issue, (status == outcome) & ~grave, current, element)]
    rules += [
        Rule("Optimization", "Third party", "Third-party URL redirects", status == "Redirect", F.concat("hops", F.lit(" redirect(s)")), element),
        Rule("Important", "Third party", "Third-party URL over http:// (insecure)", insecure & (F.col("kind") != "Link"), element, element),
        Rule("Optimization", "Third party", "Third-party URL over http:// (insecure)", insecure & (F.col("kind") == "Link"), element, element),
    ]
    return evaluate(_probed(uses, probes), rules, url="page").select(*COLUMNS)


def image_alt_summary(elements: DataFrame) -> DataFrame:
    """(url, images, with_alt, missing, empty, status) of each page; an empty text is right for decoration that says so."""
    image, alt = F.col("tag") == "img", _attr("alt")
    decorative = F.coalesce(_attr("aria-hidden") == "true", F.lit(False)) | F.coalesce(_attr("role").isin("presentation", "none"), F.lit(False))
    missing = image & alt.isNull()
    empty = image & (F.trim(alt) == "") & ~decorative
    counts = _page(elements).groupBy("url").agg(F.count_if(image).alias("images"), F.count_if(missing).alias("missing"), F.count_if(empty).alias("empty"))
    status = F.when(F.col("missing") > 0, "Error").when(F.col("empty") > 0, "Warning").otherwise("Correct")
    return counts.select("url", "images", (F.col("images") - F.col("missing") - F.col("empty")).alias("with_alt"), "missing", "empty", status.alias("status"))


def image_endings(elements: DataFrame) -> DataFrame:
    """(format, images) over all pages, by the ending of the address."""
    src = F.lower(F.regexp_extract(F.coalesce(_attr("src"), _attr("data-src"), F.lit("")), r"\.([A-Za-z0-9]+)(?:$|[?#])", 1))
    return _page(elements).where("tag = 'img'").groupBy(F.coalesce(F.nullif(src, F.lit("")), F.lit("unknown")).alias("format")).agg(F.count("*").alias("images"))


def font_faces(sheets: DataFrame) -> DataFrame:
    """(url, family, formats, display, files) of each face with files in the style sheets (url, body); local faces load nothing."""
    blocks = sheets.select("url", F.explode(F.regexp_extract_all("body", F.lit(r"@font-face\s*\{([^}]*)\}"), F.lit(1))).alias("b"))
    files = F.regexp_extract_all("b", F.lit(r"url\(\s*['\"]?([^)'\"]+)['\"]?\s*\)"), F.lit(1))
    family = F.trim(F.regexp_replace(F.regexp_extract("b", r"font-family\s*:\s*([^;]+)", 1), "['\"]", ""))
    ending = lambda f: F.coalesce(F.nullif(F.lower(F.regexp_extract(f, r"\.(\w+)(?:$|[?#])", 1)), F.lit("")), F.lit("?"))
    display = F.regexp_extract("b", r"font-display\s*:\s*(\w+)", 1)
    rows = blocks.select("url", F.coalesce(F.nullif(family, F.lit("")), F.lit("?")).alias("family"), F.array_sort(F.array_distinct(F.transform(files, ending))).alias("formats"), display.alias("display"), F.size(files).alias("files"))
    return rows.where("files > 0")


def font_rules(faces: DataFrame) -> DataFrame:
    """Site-wide issues of faces in old formats or without a display rule."""
    old = F.array_except("formats", F.array(F.lit("woff2"), F.lit("woff")))
    rows = faces.withColumns({"at": F.lit(SITE_WIDE), "old": old})
    return evaluate(rows, [
        Rule("Optimization", "Fonts", "Font file not in WOFF2 / WOFF format", F.size("old") > 0, F.concat("family", F.lit(": "), F.array_join("old", ", ")), F.col("url")),
        Rule("Optimization", "Fonts", "font-display not set (text invisible while the font loads)", F.col("display") == "", F.col("family"), F.col("url")),
    ], url="at").select(*COLUMNS)


def manifest_rules(manifests: DataFrame) -> DataFrame:
    """Site-wide issues of web manifests (url, status, body): not an object of JSON, keys without a value, icon sizes not named."""
    rows = manifests.select("url", "status", F.try_parse_json("body").alias("v"), F.lit(SITE_WIDE).alias("at"))
    good = F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit(False))
    lacks = lambda k: F.coalesce(F.try_variant_get("v", f"$.{k}", "string"), F.lit("")).isin("", "false", "0", "[]", "{}")
    sizes = F.array_join(F.transform(F.try_variant_get("v", "$.icons", "array<struct<sizes:string>>"), lambda i: F.coalesce(i["sizes"], F.lit(""))), " ")
    rows = rows.withColumns({"good": good, "sizes": F.coalesce(sizes, F.lit(""))})
    rules = [Rule("Important", "Browser metadata", "Manifest is missing or invalid JSON", ~F.col("good"), F.concat(F.lit("HTTP "), "status"), F.col("url"))]
    rules += [Rule("Optimization", "Browser metadata", f"Manifest missing {k}", F.col("good") & lacks(k), None, F.col("url")) for k in MANIFEST_KEYS]
    rules += [Rule("Optimization", "Browser metadata", f"Manifest has no {s} icon", F.col("good") & ~F.contains("sizes", F.lit(s)), None, F.col("url")) for s in MANIFEST_ICONS]
    return evaluate(rows, rules, url="at").select(*COLUMNS)


def feed_facts(feeds: DataFrame) -> DataFrame:
    """(url, status, linked, is_feed, entries, links) of fetched feeds (url, status, body, linked); links are element texts or href values."""
    body = F.coalesce("body", F.lit(""))
    links = F.regexp_extract_all(body, F.lit(r"(?is)<(?:\w+:)?link\b[^>]*?\bhref=[\"']([^\"']*)[\"']"), F.lit(1))
    texts = F.regexp_extract_all(body, F.lit(r"(?is)<(?:\w+:)?link>\s*([^<]*?)\s*</"), F.lit(1))
    entries = F.regexp_count(body, F.lit(r"(?i)<(?:\w+:)?(?:item|entry)[\s>]"))
    is_feed = (F.col("status") == 200) & body.rlike(r"(?is)^\s*(<\?.*?\?>\s*)*(<!--.*?-->\s*)*<(\w+:)?(rss|feed|rdf)\b")
    return feeds.select("url", "status", "linked", is_feed.alias("is_feed"), entries.alias("entries"), F.array_remove(F.concat(texts, links), "").alias("links"))


def feed_rules(feeds: DataFrame, public: bool = True) -> DataFrame:
    """Site-wide issues of feeds: a linked one that is broken, one without entries, links to development hosts."""
    dev = F.get(F.filter("links", lambda u: u.rlike(FEED_DEV) & F.lit(public)), 0)
    rows = feed_facts(feeds).withColumns({"at": F.lit(SITE_WIDE), "dev": dev})
    return evaluate(rows, [
        Rule("Important", "Feed", "Linked RSS / Atom feed is broken", F.col("linked") & (F.col("status") != 200), F.concat(F.lit("HTTP "), "status"), F.col("url")),
        Rule("Important", "Feed", "RSS / Atom feed has no entries", F.col("is_feed") & (F.col("entries") == 0), F.lit("0 items"), F.col("url")),
        Rule("Important", "Feed", "Feed links point to a development host", F.col("is_feed") & F.col("dev").isNotNull(), F.col("dev"), F.col("url")),
    ], url="at").select(*COLUMNS)


def file_groups(files: DataFrame) -> DataFrame:
    """(kind, files, examples) of the built files among (path): all counted, the first five named."""
    marks = ("__pycache__", ".next", "node_modules", ".DS_Store", ".tsbuildinfo", ".pyc", "dist", "out")
    kind = reduce(lambda c, m: c.when(F.contains("path", F.lit(m)), m), marks[1:], F.when(F.contains("path", F.lit(marks[0])), marks[0])).otherwise("build output")
    built = files.where(F.col("path").rlike(C.ARTEFACTS)).withColumn("kind", kind)
    named = top_per_group(built, "kind", [F.col("path")], 5).groupBy("kind").agg(F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("examples"))
    return built.groupBy("kind").agg(F.count("*").alias("files")).join(named, "kind")


def message_pages(messages: DataFrame, files: DataFrame) -> DataFrame:
    """(loc, ...) of validator messages, met with the page whose stored file (name, loc) they are about, by its name alone.

    A message on an unknown file keeps a null loc, so that those that count (errors and warnings) can be counted.
    """
    name: Column = F.url_decode(F.substring_index(U.raw_path(F.col("url")), "/", -1))
    known = files.groupBy(F.col("name").alias("at")).agg(F.min("loc").alias("loc"))
    counts = F.col("type").isin("error", "non-document-error") | (F.coalesce("subType", F.lit("")) == "warning")
    joined = messages.withColumns({"at": name, "counts": counts}).join(known, "at", "left")
    return joined.where("loc IS NOT NULL OR counts").drop("at")
