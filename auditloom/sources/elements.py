"""Pages as relations: every element, text block and JSON-LD node, parsed once per page.

The standard library's parser runs inside mapInArrow over the pages, so a page is read once however many rules
look at it, and a page that cannot be parsed gives an error row instead of failing the job.
"""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose start closes an open element of the listed kinds.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}}
BLOCKS = frozenset("p li h1 h2 h3 h4 h5 h6 td th figcaption blockquote dd dt summary label button title".split())
SCHEMA = "ord int, parent int, tag string, attrs map<string,string>, text string, zone string, path array<string>, error string"


#: Wide containers, whose text is that of their parts: they carry none of their own.
WIDE = frozenset("html head body main section article header footer nav aside div form fieldset ul ol dl table thead tbody tfoot tr".split())
#: Pages that are parsed before their elements are handed on.
CHUNK = 200


class _Tree(HTMLParser):
    """Elements in document order. Text is kept once, in pieces; an element knows its first piece and the one after its last."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[int] = []
        self.pieces: list[str] = []

    def _close(self, at: int) -> None:
        for i in self.open[at:]:
            self.rows[i]["to"] = len(self.pieces)
        del self.open[at:]

    def handle_starttag(self, tag, attrs):
        while self.open and self.rows[self.open[-1]]["tag"] in CLOSES.get(tag, ()):
            self._close(len(self.open) - 1)
        path = [self.rows[i]["tag"] for i in self.open]
        zone = "footer" if "footer" in path + [tag] else "header" if "header" in path + [tag] or "nav" in path + [tag] else "content"
        at = len(self.pieces)
        self.rows.append({"ord": len(self.rows), "parent": self.open[-1] if self.open else -1, "tag": tag, "attrs": {k: v or "" for k, v in attrs}, "own": [], "from": at, "to": at, "zone": zone, "path": path})
        if tag not in VOID:
            self.open.append(len(self.rows) - 1)

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[at]]["tag"] == tag:
                self._close(at)
                return

    def handle_data(self, data):
        if self.open and self.rows[self.open[-1]]["tag"] in ("script", "style", "template", "noscript"):
            self.rows[self.open[-1]]["own"].append(data)
        elif self.open:
            self.pieces.append(data)

    def close(self):
        super().close()
        self._close(0)


def parse(html: str) -> list[dict]:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    for row in tree.rows:
        own, first, last = row.pop("own"), row.pop("from"), row.pop("to")
        parts = [] if row["tag"] in WIDE else [*own, *tree.pieces[first:last]]
        row["text"] = " ".join(" ".join(parts).split())
    return tree.rows


def html_elements(pages: DataFrame, keys: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row for each element of (keys, html) in document order; a failure is one row with `error`.

    `keys` tell pages apart: the url, more where several pages have the same. The text of an element is that of
    all it holds, single-spaced; wide containers (WIDE) have none.
    """
    types = [pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
    names = ("ord", "parent", "tag", "attrs", "text", "zone", "path", "error")

    def elements(part):
        out = {k: [] for k in names}
        of = []
        for at, html in enumerate(part.column(len(keys)).to_pylist()):
            try:
                rows, error = parse(html or ""), None
            except (AssertionError, ValueError) as failure:
                rows, error = [{"ord": -1, "parent": -1, "tag": "", "attrs": {}, "text": "", "zone": "", "path": []}], str(failure)
            for row in rows:
                of.append(at)
                out["error"].append(error)
                for k, v in row.items():
                    out[k].append(list(v.items()) if k == "attrs" else v)
        known = [part.column(i).take(pa.array(of, pa.int32())) for i in range(len(keys))]
        return pa.RecordBatch.from_arrays([*known, *[pa.array(out[k], t) for k, t in zip(names, types, strict=True)]], [*keys, *names])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                yield elements(batch.slice(at, CHUNK))

    kept = pages.select(*keys, "html")
    return kept.mapInArrow(run, ", ".join([*[f"{k} {kept.schema[k].dataType.simpleString()}" for k in keys], SCHEMA]))


def text_blocks(elements: DataFrame) -> DataFrame:
    """Leaf blocks of text with their zone, in document order."""
    return elements.where(F.col("tag").isin(*BLOCKS) & (F.col("text") != "")).select("url", "ord", "tag", "zone", "text")


def jsonld_nodes(elements: DataFrame) -> DataFrame:
    """(url, block, type, keys, raw) of every object with an @type in the pages' JSON-LD, nested ones included.

    `@graph` members are visited once. A block that is not JSON gives one row of type `(invalid)`.
    """
    blocks = elements.where((F.col("tag") == "script") & (F.lower(F.col("attrs")["type"]) == "application/ld+json")).select("url", "ord", "text")

    def nodes(x):
        if isinstance(x, list):
            for y in x:
                yield from nodes(y)
        elif isinstance(x, dict):
            if "@type" in x:
                yield x
            for y in x.values():
                yield from nodes(y)

    def run(batches):
        for batch in batches:
            rows = []
            for url, at, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    for n in nodes(json.loads(text)):
                        kinds = n["@type"] if isinstance(n["@type"], list) else [n["@type"]]
                        rows += [(url, at, k, sorted(n), json.dumps(n, sort_keys=True)) for k in kinds if isinstance(k, str)]
                except ValueError:
                    rows.append((url, at, "(invalid)", [], text))
            u, b, t, k, r = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.string()), pa.array(b, pa.int32()), pa.array(t, pa.string()), pa.array(k, pa.list_(pa.string())), pa.array(r, pa.string())], ["url", "block", "type", "keys", "raw"])

    return blocks.mapInArrow(run, "url string, block int, type string, keys array<string>, raw string")
