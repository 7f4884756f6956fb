"""HTML extraction by differencing each page with the page of its host whose URL is nearest.

1. A page is cut into lines: the texts of its blocks, in page order, without markup, scripts and styles, character
   references decoded, white space as one space. The tags say of each line where it stands: in a named part that is
   never article (menu, header, footer, sidebar, notice, advert, form, reader comments), in the article or main
   element, or elsewhere.
2. Pages of a host are put in order of their paths. Each is paired with the page before or after it: the one whose
   path shares more leading segments, the one before if both do. Pages with the same lines count as one; if the
   nearer page is another version of this one (four fifths of its prose or more are the same) the other is taken, and if both
   are, the page has none.
3. The lines of both are aligned by longest common subsequence, and the shared lines are deleted: what two pages
   of a site have alike in the same order is its frame. In an article or main element, where the page's author says
   that the text begins, only shared lines that are no prose are deleted (under `PROSE` words, no full stop, such as "Share"), since
   articles also quote and repeat each other; headings stay.
4. What is left are the lines of the article, if there is one, else all lines elsewhere. Lines in named parts never count.

Hosts of any size: the pages' lines travel as 64-bit hashes, are numbered by sorted ranges (`shared.numbered`) and meet
their neighbours by an equi-join of numbers, so no task holds a host. Only pages that lose lines by differencing
have a row of what to keep; these rows are joined back by host and content, broadcast if counted small. Longest common
subsequences are found with bit vectors (a machine word for 64 lines) and divided in two until the table of a part is
small, so pages of very many lines need neither quadratic memory nor a cap.

Defined cases: a null or empty html has an empty text; a null url has host and path empty, and such pages form one
host. An unclosed comment, script or style ends with the page; an unclosed quotation mark in a tag ends with the next
`>`. End tags that are missing are implied, those without a start are ignored. A host of one page is cut by its tags
alone. Repeated rows get equal texts. Ties in order are broken by query and content. Extra columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SMALL_ROWS, cut_lineage, numbered
from .url_filter import host_and_path

#: Shared lines of an article that have so many words or more, or end as a sentence does, are prose and stay.
PROSE = 5
_STOPS = (".", "!", "?", "…", ":", ";", "。", "！", "？")
#: A page that has this share of this page's prose is another version of it.
VERSION = 0.8
#: Links in a row that are a menu where no element says so, and the share of a line's letters that links make up.
LINKS, LINKED = 3, 0.8
#: Bits of the table of one part of an alignment.
_TABLE = 1 << 22

# Fixed values of HTML: elements whose content is no text, that stand alone, and that begin a block.
RAW = frozenset("script style template noscript svg math iframe object textarea select title head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table"
    " tbody td tfoot th thead tr ul xmp".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of the first ends an open one of the second, unless a part of the third stands between.
_CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup"}
_P, _NOT_P = {"p"}, BLOCK - {"p"}
_IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

#: Elements and roles that are never article.
PARTS = frozenset("nav footer aside menu dialog search button fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status".split())
#: Words of class and id names that say the same. A name is cut at signs and at capitals.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot adunit sponsor sponsored sponsors promo promos promotion"
    " nav navbar navigation navmenu menu menus submenu topbar breadcrumb breadcrumbs pagination pager"
    " masthead footer footers colophon copyright sidebar sidebars rail aside widget widgets"
    " cookie cookies consent gdpr notice notices notification notifications alert banner banners popup modal overlay toast newsletter subscribe subscription signup login"
    " comment comments commentlist respond disqus replies reply discussion"
    " share sharing social socials related recommended recommendations trending toolbar skiplink searchform searchbox searchbar".split()
)
#: Names that hold such a word but are the article.
_CONTENT = frozenset("article articles content post entry story main body text".split())
_FRAMES = frozenset("ad ads comment comments sidebar footer nav menu related".split())
#: Names that speak of the page around a part, or of its absence.
_AROUND = frozenset("wrap wrapper wrapping container layout page has no with without is not".split())
_HEADER = frozenset("header header-wrapper site-header page-header top-header siteheader pageheader".split())

_TAG = re.compile(r"<(?:!--(?P<comment>-?>|.*?(?:--!?>|\Z))|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(?P<other>[!?/][^>]*+(?:>|\Z)))", re.S)
_PLAIN = re.compile(r"<(?:!--(?P<comment>-?>|.*?(?:--!?>|\Z))|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>[^>]*+)>|(?P<other>[!?/][^>]*+(?:>|\Z)))", re.S)
_NAMED = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_END_OF = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}
_OPEN_OF = {name: re.compile(rf"<(/?){name}(?=[\s/>])", re.I) for name in ("svg", "math", "object", "template")}

#: Where a line stands. In a form no line counts, but an article may begin (some pages are one form); in the header of
#: an article its headings count.
OPEN, ARTICLE, FRAME, HEADER, FORM, LINKS_ONLY = range(6)


def _names_a_part(attributes: str) -> bool | None:
    """True if class, id or role name a part that is never article, None if they name a header."""
    header = False
    for key, a, b, c in _NAMED.findall(attributes):
        key, value = key.lower(), a or b or c
        if key in ("hidden", "aria-hidden"):
            if key == "hidden" or value.lower() == "true":
                return True
        elif key == "role":
            if value.lower().strip() in ROLES:
                return True
        else:
            for name in value.split():
                if name.lower() in _HEADER:
                    header = True
                words = {w.lower() for w in _PIECES.findall(name)}
                if words & NAMES and not words & _AROUND and (words & _FRAMES or not words & _CONTENT):
                    return True
    return None if header else False


class _Page:
    """One pass over the tags of a page; `lines` are (zone, is heading, text)."""

    def __init__(self, html: str):
        self.lines: list[tuple[int, bool, str]] = []
        self.held: list[str] = []
        self.stack: list[tuple[str, int]] = []  # element, zone inside
        self.heading = self.in_link = False
        self.links = self.linked = 0
        self._read(html)
        self._flush()

    def _zone(self) -> int:
        return self.stack[-1][1] if self.stack else OPEN

    def _hold(self, text: str) -> None:
        self.held.append(text)
        if self.in_link:
            self.linked += sum(map(str.isalnum, text))

    def _flush(self) -> None:
        if self.held:
            raw = "".join(self.held)
            text = " ".join(entities.unescape(raw).split())
            if text:
                zone = self._zone()
                if zone == OPEN and self.linked and not self.heading and self.linked >= LINKED * sum(map(str.isalnum, raw)):
                    zone = LINKS_ONLY if self.links < LINKS else FRAME
                self.lines.append((zone, self.heading, text))
            self.held = []
        self.links, self.linked = int(self.in_link), 0

    def _pop(self, names: set, until: set) -> None:
        """Close the innermost open element of these names, if no one of `until` stands inside of it."""
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name in names:
                self._flush()
                del self.stack[i:]
                self.heading = any(n in HEADINGS for n, _ in self.stack)
                return
            if name in until:
                return

    def _start(self, name: str, attributes: str) -> None:
        if name in BLOCK:
            self._flush()
            if name in _CLOSES_P:
                self._pop(_P, _NOT_P)
            if name in _IMPLIED:
                closed, until = _IMPLIED[name]
                for _ in range(2):  # a row ends its cell and the row before
                    self._pop(closed, until)
        if name in VOID:
            if name == "br":
                self._hold(" ")
            return
        if name == "a":
            self.in_link, self.links = True, self.links + 1
        zone = self._zone()
        named = _names_a_part(attributes) if attributes and zone != FRAME else False
        if name in ("html", "body"):
            named = False
        if named or name in PARTS:
            zone = FRAME
        elif name == "form" and zone != FRAME:
            zone = FORM
        elif (name == "header" or named is None) and zone in (OPEN, ARTICLE):
            zone = FRAME if zone == OPEN else HEADER
        elif name in ("article", "main") and zone in (OPEN, FORM):
            zone = ARTICLE
        elif name in HEADINGS and zone == HEADER:
            zone = ARTICLE  # the title in the header of an article
        if name in HEADINGS:
            self.heading = True
        if zone != self._zone() and name not in BLOCK:
            self._flush()
        self.stack.append((name, zone))

    def _end(self, name: str) -> None:
        if name == "a" or name in BLOCK:
            if name in BLOCK:
                self._flush()
            self.in_link = False
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == name), None)
        if at is None:
            if name == "p":
                self._flush()
            return
        around = self.stack[at - 1][1] if at else OPEN
        if name not in BLOCK and self.stack[at][1] == around and any(n in BLOCK for n, _ in self.stack[at + 1 :]):
            del self.stack[at]  # an inline element that ends inside of a later block: the block stays open
            return
        if name in BLOCK or self.stack[at][1] != around:
            self._flush()
        del self.stack[at:]
        self.heading = any(n in HEADINGS for n, _ in self.stack)

    def _read(self, html: str) -> None:
        at, end, pattern = 0, len(html), _TAG
        while at < end:
            less = html.find("<", at)
            if less < 0:
                self._hold(html[at:])
                return
            if less > at:
                self._hold(html[at:less])
            found = pattern.match(html, less)
            if found is None:
                following = html[less + 1 : less + 3].lstrip("/")[:1]
                if not (following.isascii() and following.isalpha()):
                    self._hold("<")
                    at = less + 1
                    continue
                pattern = _PLAIN  # a quotation mark without end: from here on tags end with the next >
                found = pattern.match(html, less)
                if found is None:
                    return  # a tag without end
            at = found.end()
            name = found["name"]
            if name is None:
                continue
            name = name.lower()
            if found["close"]:
                self._end(name)
            elif name in RAW:
                if not found["attributes"].endswith("/") or name not in ("svg", "math"):
                    at = self._after(html, name, at)
            else:
                self._start(name, found["attributes"])

    @staticmethod
    def _after(html: str, name: str, at: int) -> int:
        """The place after the end of an element whose content is no text."""
        depth = 1
        nested = _OPEN_OF.get(name)
        if nested is None:
            if name == "head":  # left out, its end is where the body begins
                found = re.compile(r"</head(?=[\s/>])[^>]*>|(?=<body[\s>/])", re.I).search(html, at)
                return found.end() if found else at
            found = _END_OF[name].search(html, at)
            return found.end() if found else len(html)
        for found in nested.finditer(html, at):
            depth += -1 if found[1] else 1
            if not depth:
                close = html.find(">", found.end())
                return close + 1 if close >= 0 else len(html)
        return len(html)


def page_lines(html: str | None) -> list[tuple[int, bool, str]]:
    """(zone, heading, text) of the lines that may be main text, in page order: the article's, else those in no named part."""
    lines = _Page(html or "").lines
    if any(line[0] == ARTICLE for line in lines):
        return [line for line in lines if line[0] == ARTICLE]
    out, run = [], []
    for line in [*lines, (FRAME, False, "")]:
        if line[0] == LINKS_ONLY:
            run.append((OPEN, *line[1:]))
            continue
        if len(run) < LINKS:  # more links in a row are a menu
            out += run
        run = []
        if line[0] == OPEN:
            out.append(line)
    return out


def line_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of each prefix of `a` with the whole of `b`, by bit vectors."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def common(a: list[int], b: list[int]) -> list[int]:
    """Places in `a` of one longest common subsequence of both.

    Values that only one side has, and equal ends, are settled first. The rest is divided (the cut of `b` that
    the halves of `a` can share best) until a plain table of it is small.
    """
    there_a, there_b = set(a), set(b)
    keep = [i for i, x in enumerate(a) if x in there_b]
    a, b = [a[i] for i in keep], [x for x in b if x in there_a]
    out: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append(a0)
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            out.append(a1 - 1)
            a1, b1 = a1 - 1, b1 - 1
        n, m = a1 - a0, b1 - b0
        if not n or not m:
            continue
        if n == 1:
            if a[a0] in b[b0:b1]:
                out.append(a0)
        elif n * m <= _TABLE:
            out += _walk(a[a0:a1], b[b0:b1], a0)
        else:
            half = (a0 + a1) // 2
            left = _lengths(b[b0:b1], a[a0:half])
            right = _lengths(b[b0:b1][::-1], a[half:a1][::-1])[::-1]
            cut = b0 + int(np.argmax(left + right))
            todo += [(a0, half, b0, cut), (half, a1, cut, b1)]
    return [keep[i] for i in sorted(out)]


def _walk(a: list[int], b: list[int], shift: int) -> list[int]:
    """The same by keeping the bit vector after each line of `a`, and walking back from the end."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | (1 << j)
    full = (1 << len(b)) - 1
    rows = [full]
    for x in a:
        u = rows[-1] & places.get(x, 0)
        rows.append(((rows[-1] + u) | (rows[-1] - u)) & full)
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append(shift + i)
        elif (rows[i - 1] & ((1 << j) - 1)).bit_count() == (rows[i] & ((1 << j) - 1)).bit_count():
            i -= 1
        else:
            j -= 1
    return out


def segments(path: str) -> list[str]:
    return path.split("/")


def partner(own: dict, near: list[dict]) -> list[int] | None:
    """Places of the own lines that the nearest page shares; None if there is none that is no version of this one.

    `own` and each of `near` (the page before, then the page after) have path, hashes; `own` has sizes too.
    """
    mine = segments(own["path"])

    def alike(other: dict) -> int:
        n = 0
        for x, y in zip(mine, segments(other["path"]), strict=False):
            if x != y:
                break
            n += 1
        return n

    prose = [s >> 2 if s & 2 else 0 for s in own["sizes"]]
    for other in sorted(near, key=alike, reverse=True):
        shared = common(own["hashes"], other["hashes"])
        if not sum(prose) or sum(prose[i] for i in shared) < VERSION * sum(prose):
            return shared
    return None


def _parts(url) -> dict:
    """Columns host, path and query of a url, each empty where it has none."""
    host, path = host_and_path(url)
    return {"host": host, "path": path, "query": F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*(.*)$", 1), F.lit(""))}


def _hashed(lines: list[tuple[int, bool, str]]) -> tuple[list[int], list[int], str]:
    """Hash of each line; its size, with a bit for prose and one for lines that sharing does not delete; hash of all."""
    hashes, sizes = [], []
    for zone, heading, text in lines:
        prose = len(text.split()) >= PROSE or text.endswith(_STOPS)
        hashes.append(line_hash(text))
        sizes.append(len(text) << 2 | prose << 1 | (zone == ARTICLE and (prose or heading)))
    raw = np.array([hashes, sizes], np.int64).tobytes()
    return hashes, sizes, xxhash.xxh3_128_hexdigest(raw)


def _fingerprints(batches):
    for batch in batches:
        hosts = batch.column(0).to_pylist()
        rows = [_hashed(page_lines(h)) for h in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array([f"{c} {h}" for (_, _, c), h in zip(rows, hosts, strict=True)], pa.string()), pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.int64()))],
            ["host", "path", "query", "key", "hashes", "sizes"],
        )


def _keep(batches):
    for batch in batches:
        keys, masks = [], []
        for r in batch.to_pylist():
            near = [p for p in (r["before"], r["after"]) if p is not None]
            shared = partner(r, near) if near else None
            gone = [i for i in shared or () if not r["sizes"][i] & 1]
            if gone:
                mask = [True] * len(r["sizes"])
                for i in gone:
                    mask[i] = False
                keys.append(r["key"])
                masks.append(mask)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(masks, pa.list_(pa.bool_()))], ["key", "keep"])


def _lines(batches):
    for batch in batches:
        found = [page_lines(h) for h in batch.column(3).to_pylist()]
        keys = [f"{_hashed(lines)[2]} {h}" for lines, h in zip(found, batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(keys, pa.string()), pa.array([[t for _, _, t in lines] for lines in found], pa.list_(pa.string()))], ["page_id", "url", "key", "lines"])


def shared_lines(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, keep) of the contents of a host that lose lines to their nearest page, and (key, n) of all contents."""
    where = pages.select(F.col("url").cast("string").alias("_url"), F.col("html").cast("string").alias("_html"))
    parts = where.select(*[c.alias(n) for n, c in _parts(F.col("_url")).items()], "_html")
    prints = parts.mapInArrow(_fingerprints, "host string, path string, query string, key string, hashes array<long>, sizes array<long>")
    one = prints.groupBy("host", "key").agg(F.count("*").alias("n"), F.min(F.struct("path", "query")).alias("at"), F.first("hashes").alias("hashes"), F.first("sizes").alias("sizes"))
    one = one.select("host", "key", "n", F.col("at.path").alias("path"), F.col("at.query").alias("query"), "hashes", "sizes", F.translate("at.path", "/", "\x01").alias("_order"))
    laid = numbered(one, "host", "_order", "query", "key")
    page = F.struct("path", "hashes")
    before = laid.select((F.col("number") + 1).alias("number"), F.col("host").alias("_host"), page.alias("before"))
    after = laid.select((F.col("number") - 1).alias("number"), F.col("host").alias("_host"), page.alias("after"))
    for other in (before, after):
        laid = laid.join(other, "number", "left").withColumn(other.columns[2], F.when(F.col("host") == F.col("_host"), F.col(other.columns[2]))).drop("_host")
    masks = cut_lineage(laid.select("key", "path", "hashes", "sizes", "before", "after").mapInArrow(_keep, "key string, keep array<boolean>"))
    return masks, laid.select("key", "n")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    masks, contents = shared_lines(pages)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("url").cast("string").alias("_url"), F.col("html").cast("string").alias("_html"))
    rows = rows.select("page_id", "url", _parts(F.col("_url"))["host"].alias("host"), "_html").mapInArrow(_lines, "page_id long, url string, key string, lines array<string>")
    size = masks.agg(F.count("*").alias("n"), F.sum(F.size("keep")).alias("lines")).first()
    if size.n <= SMALL_ROWS and (size.lines or 0) <= 20 * SMALL_ROWS:
        rows = rows.join(F.broadcast(masks), "key", "left")
    else:
        # contents that fill a task, few whatever the size of the table, meet what to keep where they are
        hot = cut_lineage(contents.where(F.col("n") > max(1_000, contents.agg(F.sum("n")).first()[0] // SMALL_ROWS)).select("key"))
        there = rows.join(F.broadcast(hot), "key").join(F.broadcast(masks.join(F.broadcast(hot), "key", "left_semi")), "key", "left")
        rows = there.unionByName(rows.join(F.broadcast(hot), "key", "left_anti").join(masks, "key", "left"))
    kept = F.when(F.col("keep").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda _, i: F.get("keep", i)))
    text = F.array_join(kept, "\n\n")
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
