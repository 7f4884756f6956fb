"""Rules over the element table: headings, images, forms, ids, labels, social tags, structured data.

Each function takes elements (see auditloom.sources.elements) and gives issue columns url, severity, category,
issue, current_value, element. Order-dependent rules are window functions over a page's elements.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import Rule, evaluate

COLUMNS = ("url", "severity", "category", "issue", "current_value", "element")


def _attr(name: str) -> Column:
    return F.col("attrs")[name]


def _page(elements: DataFrame) -> DataFrame:
    return elements.where("error IS NULL")


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(*COLUMNS) for p in parts])


def heading_rules(elements: DataFrame) -> DataFrame:
    """Missing, extra, first, skipped, empty, long and duplicate headings."""
    heads = _page(elements).where(F.col("tag").rlike("^h[1-6]$")).withColumn("level", F.substring("tag", 2, 1).cast("int"))
    order = Window.partitionBy("url").orderBy("ord")
    heads = heads.withColumns({"before": F.lag("level").over(order), "nth": F.row_number().over(order), "nth_h1": F.sum(F.when(F.col("level") == 1, 1).otherwise(0)).over(order)})
    heads = heads.withColumn("same", F.count("*").over(Window.partitionBy("url", F.lower("text"))))
    label = F.concat("tag", F.lit(": "), "text")
    each = evaluate(heads, [
        Rule("Important", "Headings", "First heading is not H1", (F.col("nth") == 1) & (F.col("level") != 1), label),
        Rule("Important", "Headings", "Multiple H1", (F.col("level") == 1) & (F.col("nth_h1") > 1), label),
        Rule("Optimization", "Headings", "Skipped heading level", F.col("level") > F.col("before") + 1, F.concat(F.lit("H"), "before", F.lit(" → H"), "level"), label),
        Rule("Important", "Headings", "Empty heading", F.col("text") == "", F.col("tag")),
        Rule("Optimization", "Headings", "Very long heading", F.length("text") > 90, label),
        Rule("Optimization", "Headings", "Duplicate heading text on page", (F.col("same") > 1) & (F.col("level") <= 3) & (F.col("text") != ""), F.col("text")),
    ])
    pages = _page(elements).groupBy("url").agg(F.count_if(F.col("tag").rlike("^h[1-6]$")).alias("n"), F.count_if(F.col("tag") == "h1").alias("n_h1"))
    whole = evaluate(pages, [Rule("Critical", "Headings", "No headings on page", F.col("n") == 0), Rule("Critical", "Headings", "Missing H1", (F.col("n") > 0) & (F.col("n_h1") == 0))])
    return _union(each, whole)


def heading_outline(headings: DataFrame) -> DataFrame:
    """(url, ord, prev_level, level, outline, skipped) of headings (url, ord, level, text): indented, with level jumps."""
    rows = headings.withColumn("prev_level", F.lag("level").over(Window.partitionBy("url").orderBy("ord")))
    skipped = F.coalesce(F.col("level") > F.col("prev_level") + 1, F.lit(False))
    return rows.select("url", "ord", "prev_level", "level", F.concat(F.repeat(F.lit("    "), F.col("level") - 1), "text").alias("outline"), skipped.alias("skipped"))


def missing_fragments(refs: DataFrame) -> DataFrame:
    """(url, ref) of in-page links (kind a) of (url, kind, ref) to an id or name that the page does not have."""
    return refs.where("kind = 'a'").select("url", "ref").join(refs.where("kind <> 'a'").select("url", "ref"), ["url", "ref"], "left_anti")


def alternate_problems(rows: DataFrame) -> DataFrame:
    """(page, code, href, invalid, no_return) of alternates (page, code, href): codes that are none, pages that do not link back."""
    code = F.lower("code")
    invalid = ~code.rlike("^([a-z]{2,3}(-[a-z]{4})?(-([a-z]{2}|[0-9]{3}))?|x-default)$") | code.rlike("-(uk|en|eu)$")
    back = rows.select(F.col("href").alias("page"), F.col("page").alias("href")).distinct().withColumn("back", F.lit(True))
    joined = rows.join(back, ["page", "href"], "left")
    return joined.select("page", "code", "href", invalid.alias("invalid"), ((F.col("page") != F.col("href")) & F.col("back").isNull()).alias("no_return"))


def image_rules(elements: DataFrame) -> DataFrame:
    """Missing and poor alt texts, sizes and loading of images."""
    images = _page(elements).where("tag = 'img'").withColumn("nth", F.row_number().over(Window.partitionBy("url").orderBy("ord")))
    images = images.withColumns({"src": F.coalesce(_attr("src"), F.lit("")), "alt": _attr("alt"), "loading": F.lower(F.coalesce(_attr("loading"), F.lit("")))})
    return evaluate(images, [
        Rule("Important", "Alt text", "Image without alt attribute", F.col("alt").isNull(), F.col("src")),
        Rule("Optimization", "Alt text", "Alt text too long", F.length("alt") > 125, F.col("alt")),
        Rule("Optimization", "Alt text", "Alt text is a file name", F.lower("alt").rlike(r"\.(jpe?g|png|gif|webp|svg|avif)$"), F.col("alt")),
        Rule("Important", "Source", "Image without src", F.col("src") == "", F.lit("")),
        Rule("Optimization", "Layout", "Image without width/height", _attr("width").isNull() | _attr("height").isNull(), F.col("src")),
        Rule("Optimization", "Loading", "Image below the fold is not lazy", (F.col("nth") >= 3) & (F.col("loading") != "lazy"), F.col("src")),
        Rule("Optimization", "Loading", "First image is lazy", (F.col("nth") == 1) & (F.col("loading") == "lazy"), F.col("src")),
    ]).select(*COLUMNS)


def duplicate_ids(elements: DataFrame) -> DataFrame:
    """(url, id, n) of ids that several elements of a page carry."""
    ids = _page(elements).withColumn("id", _attr("id")).where("id IS NOT NULL AND id <> ''")
    return ids.groupBy("url", "id").agg(F.count("*").alias("n")).where("n > 1")


def accessibility_rules(elements: DataFrame) -> DataFrame:
    """Names of controls, references to missing ids, page language."""
    page = _page(elements)
    ids = page.select("url", _attr("id").alias("ref")).where("ref IS NOT NULL").distinct()
    refs = page.select("url", "tag", F.explode(F.array("attrs.aria-labelledby", "attrs.aria-describedby", "attrs.aria-controls")).alias("list")).where("list IS NOT NULL")
    refs = refs.select("url", "tag", F.explode(F.split(F.trim("list"), r"\s+")).alias("ref")).where("ref <> ''")
    missing = refs.join(ids, ["url", "ref"], "left_anti").select("url", F.lit("Important").alias("severity"), F.lit("ARIA").alias("category"), F.lit("ARIA reference to a missing id").alias("issue"), F.col("ref").alias("current_value"), F.col("tag").alias("element"))
    labels = page.where("tag = 'label'").select("url", _attr("for").alias("ref")).where("ref IS NOT NULL").distinct().withColumn("labelled", F.lit(True))
    named = (F.col("text") != "") | F.coalesce(_attr("aria-label"), _attr("aria-labelledby"), _attr("title"), F.lit("")).rlike(r"\S")
    fields = page.where(F.col("tag").isin("input", "select", "textarea") & ~F.lower(F.coalesce(_attr("type"), F.lit(""))).isin("hidden", "submit", "button", "image", "reset"))
    fields = fields.withColumn("ref", _attr("id")).join(labels, ["url", "ref"], "left")
    controls = evaluate(page, [
        Rule("Important", "Names", "Button without accessible name", (F.col("tag") == "button") & ~named, F.lit("")),
        Rule("Important", "Names", "Link without text or accessible name", (F.col("tag") == "a") & _attr("href").isNotNull() & ~named, _attr("href")),
        Rule("Important", "Names", "iframe without title", (F.col("tag") == "iframe") & (F.coalesce(_attr("title"), F.lit("")) == ""), _attr("src")),
        Rule("Critical", "Language", "html without lang", (F.col("tag") == "html") & (F.coalesce(_attr("lang"), F.lit("")) == "")),
        Rule("Important", "Keyboard", "Positive tabindex", F.expr("try_cast(attrs['tabindex'] AS int)") > 0, _attr("tabindex")),
    ])
    unlabelled = evaluate(fields, [Rule("Critical", "Forms", "Form field without label", F.col("labelled").isNull() & ~named & ~F.array_contains("path", "label"), F.coalesce(_attr("name"), F.col("tag")))])
    return _union(controls, unlabelled, missing)


def social_rules(elements: DataFrame) -> DataFrame:
    """Missing or conflicting Open Graph and Twitter tags."""
    metas = _page(elements).where("tag = 'meta'").select("url", F.lower(F.coalesce(_attr("property"), _attr("name"))).alias("k"), _attr("content").alias("v"))
    wanted = ["og:title", "og:description", "og:image", "og:url", "og:type", "twitter:card"]
    by_page = metas.where(F.col("k").isin(*wanted)).groupBy("url").pivot("k", wanted).agg(F.first("v"))
    pages = _page(elements).select("url").distinct().join(by_page, "url", "left")
    weight = {"og:title": "Important", "og:description": "Important", "og:image": "Important"}
    return evaluate(pages, [Rule(weight.get(k, "Optimization"), "Social", f"{k} missing", F.coalesce(F.col(f"`{k}`"), F.lit("")) == "") for k in wanted]).select(*COLUMNS)


def security_rules(responses: DataFrame) -> DataFrame:
    """Missing and weak security headers and cookie flags of responses (url, headers, https)."""
    h = F.col("h")
    rows = responses.withColumn("h", F.map_from_entries(F.transform(F.map_entries("headers"), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))))
    wanted = {"strict-transport-security": "Important", "content-security-policy": "Important", "x-content-type-options": "Important", "referrer-policy": "Optimization", "permissions-policy": "Optimization"}
    age = F.expr("try_cast(regexp_extract(h['strict-transport-security'], 'max-age=([0-9]+)', 1) AS long)")
    script = F.regexp_extract(F.coalesce(h["content-security-policy"], F.lit("")), "script-src([^;]*)", 1)
    rules = [Rule(s, "Headers", f"Missing {name}", h[name].isNull()) for name, s in wanted.items()] + [
        Rule("Important", "Headers", "X-Content-Type-Options is not nosniff", F.lower(h["x-content-type-options"]) != "nosniff", h["x-content-type-options"]),
        Rule("Important", "Headers", "No clickjacking protection (X-Frame-Options or CSP frame-ancestors)", h["x-frame-options"].isNull() & ~F.coalesce(h["content-security-policy"], F.lit("")).contains("frame-ancestors")),
        Rule("Optimization", "Headers", "Weak CSP for scripts ('unsafe-inline' or *)", script.contains("'unsafe-inline'") | F.concat(F.lit(" "), script, F.lit(" ")).contains(" * "), script),
        Rule("Optimization", "Headers", "HSTS max-age below 180 days", h["strict-transport-security"].isNotNull() & (F.coalesce(age, F.lit(0)) < 15552000), h["strict-transport-security"]),
        Rule("Optimization", "Exposure", "server header reveals server software", h["server"].rlike("[0-9]"), h["server"]),
        Rule("Optimization", "Exposure", "x-powered-by header reveals server software", h["x-powered-by"].isNotNull(), h["x-powered-by"]),
    ]
    cookies = rows.select("url", F.explode(F.split(h["set-cookie"], r",\s*(?=[^;,=\s]+=)")).alias("cookie"))
    flags = F.transform(F.split(F.lower("cookie"), ";"), lambda p: F.trim(F.substring_index(p, "=", 1)))
    name = F.substring_index("cookie", "=", 1)
    each = evaluate(cookies, [
        Rule("Important", "Cookies", "Cookie without Secure flag", F.col("url").startswith("https://") & ~F.array_contains(flags, "secure"), name),
        Rule("Optimization", "Cookies", "Cookie without SameSite", ~F.array_contains(flags, "samesite"), name),
    ])
    return _union(evaluate(rows, rules), each)


def forms(elements: DataFrame) -> DataFrame:
    """(signature, pages, fields): forms that are the same on all pages they occur on, by their sorted fields."""
    page = _page(elements)
    tops = page.where("tag = 'form'").select("url", F.col("ord").alias("form"), F.lead("ord", 1, 1 << 30).over(Window.partitionBy("url").orderBy("ord")).alias("upto"))
    fields = page.where(F.col("tag").isin("input", "select", "textarea") & F.array_contains("path", "form")).select("url", "ord", F.concat_ws(":", "tag", F.coalesce(_attr("type"), F.lit("")), F.coalesce(_attr("name"), F.lit(""))).alias("field"))
    inside = tops.alias("t").join(fields.alias("f"), (F.col("t.url") == F.col("f.url")) & F.col("f.ord").between(F.col("t.form"), F.col("t.upto")))
    signed = inside.groupBy("t.url", "t.form").agg(F.array_join(F.array_sort(F.collect_list("f.field")), "|").alias("signature"), F.count("*").alias("fields"))
    return signed.groupBy("signature").agg(F.count_distinct("url").alias("pages"), F.max("fields").alias("fields"))
