"""Routes of a source tree, and what each inherits from the layouts above it.

A page file stands for the route of its folder; segments in parentheses group files, those after an @ are slots, and both are no part of the route. A
layout in a folder holds for all pages below it; what the closest one does not declare comes from the next above.

A folder meets its ancestors by equality with each of its own prefixes (as many as it is deep), so no pair of paths
is compared, and a layout at the root that every page of a tree meets is broadcast or spread (`sized_join`).

Defined cases: null files are left out. Files that repeat count once; a folder's layouts that repeat declare their
least value. A page without a layout, or whose layouts declare nothing, has nulls. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sized import sized_join

#: The files that are pages and layouts.
PAGE, LAYOUT = r"(^|/)page\.(tsx|ts|jsx|js)$", r"(^|/)layout\.(tsx|ts|jsx|js)$"


def folder(file: Column) -> Column:
    return F.regexp_replace(file, "/?[^/]*$", "")


def route(directory: Column, app: str = "app") -> Column:
    """The route of a folder below the app folder: `/` for the app folder itself, groups left out."""
    below = F.regexp_replace(directory, rf"^(.*/)?{app}(?=/|$)", "")
    kept = F.filter(F.split(below, "/"), lambda s: (s != "") & ~s.rlike(r"^(\(.*\)|@.*)$"))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def page_routes(files: DataFrame, app: str = "app") -> DataFrame:
    """(graph, folder, route) of the page files of (graph, file) below the app folder."""
    pages = files.where(F.col("file").rlike(PAGE) & F.col("file").rlike(rf"(^|/){app}/"))
    return pages.select("graph", folder(F.col("file")).alias("folder")).distinct().withColumn("route", route(F.col("folder"), app))


def inherited(pages: DataFrame, layouts: DataFrame, values: list[str]) -> DataFrame:
    """`pages` (graph, folder, ...) with each of `values` as the closest layout (graph, folder, values) above declares it.

    `layouts_above` counts the layouts that hold for the page.
    """
    declared = layouts.where("folder IS NOT NULL").groupBy(F.concat_ws("\n", "graph", "folder").alias("key")).agg(*[F.min(v).alias(v) for v in values])
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("at")))
    rows = pages.where("folder IS NOT NULL").select("graph", "folder").distinct().select("graph", "folder", F.explode(above).alias("a"))
    met = sized_join(rows.select("graph", "folder", "a.depth", F.concat_ws("\n", "graph", "a.at").alias("key")), declared, "key")
    nearest = [F.max_by(v, F.when(F.col(v).isNotNull(), F.col("depth"))).alias(v) for v in values]
    found = met.groupBy(F.col("graph").alias("_graph"), F.col("folder").alias("_folder")).agg(*nearest, F.count("*").alias("layouts_above"))
    joined = pages.join(found, F.col("graph").eqNullSafe(F.col("_graph")) & (F.col("folder") == F.col("_folder")), "left")
    return joined.drop("_graph", "_folder").withColumn("layouts_above", F.coalesce("layouts_above", F.lit(0)))
