"""JSON of any shape as a relation of nodes, walked level by level over VARIANT values.

Each round explodes the objects and arrays of the level before (`variant_explode`, in the JVM) and keeps the children's
paths, until a level holds no container: a fixpoint over the depth of the deepest document, whatever the number of
documents. A level is written before the next begins.

Paths are places: `/0/3` is the fourth child of the first child of the root. Names spell the keys: `@graph[0].author`.

Defined cases: a text that is null is no document. One that is not JSON (also one that repeats a key in an object) is
one node of kind `invalid`. A container at `deepest` levels is a node of kind `too deep` and is not opened, so nesting
without end costs a bounded number of rounds. Scalars carry their text. Repeated documents are told apart by
the caller's keys. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut_lineage
from .rules import Rule, evaluate

DEEPEST = 64
#: Keys whose text is the url of a page.
PAGE_KEYS = ("url", "item", "@id", "mainEntityOfPage", "sameAs", "target")
#: Keys whose text, or whose array's texts, are urls of files and pages.
FILE_KEYS = ("url", "image", "logo", "contentUrl", "thumbnailUrl", "sameAs", "item", "@id", "mainEntityOfPage", "embedUrl")
#: Dates that must be ISO 8601.
DATES = ("datePublished", "dateModified", "uploadDate", "startDate", "validThrough")
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,6})?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"


def _kind(value: Column) -> Column:
    said = F.schema_of_variant(value)
    return F.when(said.startswith("OBJECT"), "object").when(said.startswith("ARRAY"), "array").when(said == "STRING", "string").when(said == "BOOLEAN", "boolean").when(said == "VOID", "null").otherwise("number")


def walk(documents: DataFrame, keys: list[str], json: str = "json", deepest: int = DEEPEST) -> DataFrame:
    """(keys, path, parent, depth, pos, key, name, kind, value) of every node of the documents (keys, json)."""
    # the parser stops behind the first value: only a text that is still JSON inside of an array and of an object is one value
    whole = F.try_parse_json(F.concat(F.lit("["), json, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"x":'), json, F.lit("}"))).isNotNull()
    parsed = documents.where(F.col(json).isNotNull()).select(*keys, F.when(whole, F.try_parse_json(json)).alias("v"))
    root = parsed.select(
        *keys, F.lit("").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("key"), F.lit("").alias("name"),
        F.when(F.col("v").isNull(), "invalid").otherwise(_kind(F.col("v"))).alias("kind"), "v",
    )
    level, done = cut_lineage(root), []
    for depth in range(deepest + 1):
        box = F.col("kind").isin("object", "array")
        kind = F.when(box, "too deep").otherwise(F.col("kind")) if depth == deepest else F.col("kind")
        text = F.when(~box, F.try_variant_get("v", "$", "string"))
        done.append(level.select(*keys, "path", "parent", "depth", "pos", "key", "name", kind.alias("kind"), text.alias("value")))
        boxes = level.where(box)
        if depth == deepest or boxes.limit(1).count() == 0:
            break
        boxes = boxes.select(*keys, F.col("path").alias("parent"), F.col("name").alias("above"), "v")
        children = boxes.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer()).select("pos", "key", F.col("value").alias("child")))
        name = F.concat("above", F.when(F.col("key").isNull(), F.concat(F.lit("["), "pos", F.lit("]"))).when(F.col("above") == "", F.col("key")).otherwise(F.concat(F.lit("."), "key")))
        level = cut_lineage(children.select(*keys, F.concat("parent", F.lit("/"), "pos").alias("path"), "parent", F.lit(depth + 1).alias("depth"), "pos", "key", name.alias("name"), _kind(F.col("child")).alias("kind"), F.col("child").alias("v")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def page_urls(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, key, value) of the texts under keys that name pages, in whatever nesting."""
    return nodes.where(F.col("key").isin(*PAGE_KEYS) & (F.col("kind") == "string")).select(*keys, "key", "value")


def typed_entities(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, depth, types) of the objects with an @type of texts, one or several."""
    said = nodes.where("key = '@type' AND kind = 'string'").select(*keys, F.col("parent").alias("path"), F.lit(0).alias("pos"), F.col("value").alias("type"))
    lists = nodes.where("key = '@type' AND kind = 'array'").select(*keys, F.col("path").alias("list"), F.col("parent").alias("path"))
    several = nodes.where("key IS NULL AND kind = 'string'").withColumnRenamed("parent", "list").drop("path").join(lists, [*keys, "list"]).select(*keys, "path", "pos", F.col("value").alias("type"))
    types = said.unionByName(several).groupBy(*keys, "path").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "type"))), lambda t: t["type"]).alias("types"))
    return types.withColumn("depth", F.regexp_count("path", F.lit("/")))


def file_references(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, type, key, value) of the absolute and rooted urls under keys that name files or pages, with the object's first type."""
    direct = nodes.where(F.col("key").isin(*FILE_KEYS) & (F.col("kind") == "string")).select(*keys, F.col("parent").alias("path"), "key", "value")
    lists = nodes.where(F.col("key").isin(*FILE_KEYS) & (F.col("kind") == "array")).select(*keys, F.col("path").alias("list"), F.col("parent").alias("path"), "key")
    items = nodes.where("key IS NULL AND kind = 'string'").select(*keys, F.col("parent").alias("list"), "value").join(lists, [*keys, "list"]).select(*keys, "path", "key", "value")
    found = direct.unionByName(items).where(F.col("value").rlike("^(http|/)"))
    kinds = typed_entities(nodes, keys).select(*keys, "path", F.get("types", 0).alias("type"))
    return found.join(kinds, [*keys, "path"], "left").select(*keys, F.coalesce("type", F.lit("?")).alias("type"), "key", "value")


def iso_date(text: Column) -> Column:
    """The time that an ISO 8601 date names, UTC where it names no zone; null if it is none."""
    plain = F.regexp_replace(F.regexp_replace(text, ",", "."), r"([+-]\d{2})(\d{2})$", "$1:$2")
    plain = F.regexp_replace(plain, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})(Z|[+-].*)?$", "$1:00$2")
    return F.when(text.rlike(ISO), F.coalesce(plain.try_cast("timestamp"), F.when(text.rlike(r"^.{10}$"), plain.try_cast("date").cast("timestamp"))))


def value_rules(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Issues (url, severity, category, issue, current_value, element) of values that have the wrong format.

    `keys` has the page's `url`; element is the object's name. One aggregation by object brings its properties together.
    """
    props = ("url", "logo", "image", "headline", "name", *DATES)
    held = nodes.where(F.col("key").isin(*props)).groupBy(*keys, F.col("parent").alias("path")).agg(*[F.max(F.when(F.col("key") == p, F.struct("kind", "value"))).alias(f"p_{p}") for p in props])
    kinds = typed_entities(nodes, keys).select(*keys, "path", F.get("types", 0).alias("type"))
    names = nodes.where("kind = 'object'").select(*keys, "path", F.col("name").alias("name_of"))
    rows = held.join(kinds, [*keys, "path"], "left").join(names, [*keys, "path"]).withColumn("type", F.coalesce("type", F.lit("?")))
    kind, value = (lambda p: F.col(f"p_{p}")["kind"]), (lambda p: F.col(f"p_{p}")["value"])
    shown = lambda p: F.left(F.coalesce(value(p), F.concat(F.lit("("), kind(p), F.lit(")"))), F.lit(150))
    said = lambda p, what: F.concat(F.lit("JSON-LD "), "type", F.lit(f".{p} {what}"))
    name = F.col("name_of")
    absolute = lambda p: (kind(p) == "string") & value(p).rlike("^https?://") | kind(p).isin("object", "array")
    wrong = {p: ("Important", kind(p).isNotNull() & ~absolute(p)) for p in ("url", "logo", "image")}
    wrong |= {
        "headline": ("Optimization", kind("headline").isNotNull() & ((kind("headline") != "string") | (F.length(value("headline")) > 110))),
        "name": ("Optimization", kind("name").isNotNull() & ((kind("name") != "string") | (F.length(value("name")) < 1))),
        **{p: ("Optimization", kind(p).isNotNull() & (kind(p) != "string")) for p in ("datePublished", "dateModified")},
    }
    given = lambda p: kind(p).isNotNull() & (kind(p) != "null") & (F.coalesce(value(p), F.lit("x")) != "")
    rules = [Rule(severity, "JSON-LD values", said(p, "has the wrong format"), test, shown(p), name) for p, (severity, test) in wrong.items()]
    rules += [Rule("Important", "JSON-LD values", said(p, "is not an ISO 8601 date"), given(p) & iso_date(value(p)).isNull(), F.left(shown(p), F.lit(60)), name) for p in DATES]
    before = iso_date(value("dateModified")) < iso_date(value("datePublished"))
    rules.append(Rule("Optimization", "JSON-LD values", "dateModified is before datePublished", F.coalesce(before, F.lit(False)), F.concat(value("datePublished"), F.lit(" > "), value("dateModified")), name))
    return evaluate(rows, rules)
