"""Pages as they are shown: the text of each element without spaces at inline tags, and a short label of it.

A page is parsed once, in Arrow batches, into one row: its pieces of text in document order, and for each element the
range of pieces that it holds. Texts and labels are then array functions over that row; nothing is shuffled, and a
task holds one page's elements at a time.

Defined cases: a null or empty page has no elements; comments, scripts and styles have no text; a page that the parser
refuses gives one row with `error` and an empty tag.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .elements import CHUNK, _Tree

#: Elements whose text is not running text.
HIDDEN = frozenset("script style noscript template svg code pre kbd samp".split())
#: Attributes that a label names, the first that is there, and the sizes of its parts.
NAMED = ("href", "src", "name", "type", "role", "aria-label")
LABEL, VALUE, TEXT, CLASSES = 120, 60, 40, 3
#: White space of any script, also the separators among the control characters.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"

PIECE = pa.struct([("text", pa.string()), ("shown", pa.bool_())])
ELEMENT = pa.struct([("ord", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("from", pa.int32()), ("to", pa.int32())])
SCHEMA = "url string, pieces array<struct<text:string,shown:boolean>>, elements array<struct<ord:int,parent:int,tag:string,attrs:map<string,string>,from:int,to:int>>, error string"


class _Pieces(_Tree):
    """The tree with every piece of text, those of code among them, and a space that is shown for each line break."""

    def handle_starttag(self, tag, attrs):
        super().handle_starttag(tag, attrs)
        if tag == "br":
            self.pieces.append((" ", True))

    def handle_data(self, data):
        tags = {self.rows[i]["tag"] for i in self.open}
        if self.open and not tags & {"script", "style", "template"}:
            self.pieces.append((data, not tags & HIDDEN))


def page_pieces(pages: DataFrame) -> DataFrame:
    """One row of (url, pieces, elements, error) for each page of (url, html)."""

    def page(url, html):
        try:
            tree = _Pieces()
            tree.feed(html or "")
            tree.close()
        except (AssertionError, ValueError) as failure:
            return {"url": url, "pieces": [], "elements": [{"ord": -1, "parent": -1, "tag": "", "attrs": [], "from": 0, "to": 0}], "error": str(failure)}
        elements = [{**{k: row[k] for k in ("ord", "parent", "tag", "from", "to")}, "attrs": list(row["attrs"].items())} for row in tree.rows]
        return {"url": url, "pieces": [{"text": t, "shown": s} for t, s in tree.pieces], "elements": elements, "error": None}

    def run(batches):
        types = {"url": pa.string(), "pieces": pa.list_(PIECE), "elements": pa.list_(ELEMENT), "error": pa.string()}
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                rows = [page(*pair) for pair in zip(*(c.to_pylist() for c in batch.slice(at, CHUNK).columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in types.items()], list(types))

    return pages.select("url", "html").mapInArrow(run, SCHEMA)


def _single_spaced(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, SPACE, " "))


def _label(element: Column, text: Column) -> Column:
    """tag#id.class.class [attribute=value] 'text', cut at its size."""
    attrs = element["attrs"]
    classes = F.slice(F.filter(F.split(F.coalesce(attrs["class"], F.lit("")), SPACE), lambda c: c != ""), 1, CLASSES)
    named = F.coalesce(*[F.when(attrs[a] != "", F.concat(F.lit(f" [{a}="), F.left(attrs[a], F.lit(VALUE)), F.lit("]"))) for a in NAMED], F.lit(""))
    parts = [element["tag"], F.when(attrs["id"] != "", F.concat(F.lit("#"), attrs["id"])), F.when(F.size(classes) > 0, F.concat(F.lit("."), F.array_join(classes, "."))), named]
    parts += [F.when(text != "", F.concat(F.lit(" '"), F.left(text, F.lit(TEXT)), F.lit("'")))]
    return F.left(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]), F.lit(LABEL))


def shown_elements(pages: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """(url, ord, parent, tag, label, shown, error) of every element of (url, html), or of those with the given tags.

    `shown` is the text as a reader sees it: pieces side by side, a space for a line break, none of code.
    """
    held = lambda e: F.slice(F.col("pieces"), e["from"] + 1, e["to"] - e["from"])
    every = lambda e: _single_spaced(F.array_join(F.transform(held(e), lambda p: p["text"]), " "))
    seen = lambda e: _single_spaced(F.array_join(F.transform(F.filter(held(e), lambda p: p["shown"]), lambda p: p["text"]), ""))
    row = lambda e: F.struct(e["ord"].alias("ord"), e["parent"].alias("parent"), e["tag"].alias("tag"), _label(e, every(e)).alias("label"), seen(e).alias("shown"))
    chosen = F.filter("elements", lambda e: e["tag"].isin(*tags)) if tags else F.col("elements")
    return page_pieces(pages).select("url", "error", F.inline(F.transform(chosen, row))).select("url", "ord", "parent", "tag", "label", "shown", "error")
