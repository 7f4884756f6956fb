"""Benchmark decontamination by the q-gram lemma.

An item of m bytes (of UTF-8, so a character of another alphabet counts two or three) occurs in a text if some
stretch of the text is within e edits of bytes of it, where e is the share `edits` of m. Texts and items are compared as lower-case terms (of any alphabet) joined by single
spaces.

1. Every item keeps its R rarest q-grams (q = 8 bytes), R as large as the lemma needs: an edit destroys at
   most q of them, so an occurrence shares at least R - q * e with the text.
2. Shared q-grams lie on diagonals (text position minus item position) that differ by at most e. Diagonals
   are cut into bands of 2 (e + 1) that overlap by e + 1, so one band holds all of an occurrence; hits are
   counted for each text, item and band, and bands under the bound are dropped. Nothing is lost.
3. The rest is verified by aligning the whole item within the band and its surroundings.

Items under `min_chars` bytes have too few q-grams for a budget: they are searched as they stand, whole
terms only, by the hash of their terms; a hit is compared byte by byte.

Documents are scanned where they are read: no shuffle. The items are the query set. They are taken in
blocks of at most BLOCK_CHARS characters, one pass over the documents for each block, and the result of a
pass is written before the next begins, so one block at a time is on the driver and on the executors,
whatever the size of the benchmark.

Defined cases: null and empty texts contain nothing; a text of any length is searched whole. Items that are null
or have no term are not searched. An item so short that R - q * e would not be positive gets a smaller e. Null
ids are carried as null. Repeated items and repeated rows report alike. A character whose lower case takes
another number of bytes or characters stays as it is, so that places hold in the original text; both small
sigmas are one letter. Extra columns are carried
through by `drop_contaminated`. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import cut_lineage

Q = 8
BLOCK_CHARS = 4_000_000
_BITS = 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_CLEAN = np.where(K.IS_TERM, K.LOWER, 32).astype(np.uint8)


def _folds() -> np.ndarray:
    """For each code point, the one it is compared as: its lower case, if that is one character of as many bytes."""
    table = np.arange(0x110000, dtype="<u4")
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x20000))):
        low = c.lower()
        if low != c and len(low) == 1 and len(low.encode()) == len(c.encode()):
            table[ord(c)] = ord(low)
    table[ord("\u03c2")] = ord("\u03c3")  # a sigma at the end of a word
    return table


_FOLD = _folds()


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with letters of other alphabets lower-cased, each by itself, at the same places.

    No letter looks at its neighbours, so a text is folded alike whatever texts stand beside it.
    """
    if not (data & 0x80).any():
        return data
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), "<u4")
    return np.frombuffer(_FOLD[points].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogateescape"), np.uint8)


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case terms joined by single spaces, the documents' offsets, and each byte's original place."""
    clean = _CLEAN[lowered(data)]
    edge = clean == 32
    start = np.zeros(len(clean), bool)
    start[offsets[:-1][offsets[:-1] < len(clean)]] = True
    twice = np.zeros(len(clean), bool)
    twice[1:] = edge[1:] & edge[:-1]
    keep = ~(twice & ~start)
    place = np.concatenate([[0], np.cumsum(keep)])
    return clean[keep], place[offsets], np.flatnonzero(keep)


def grams(clean: np.ndarray) -> np.ndarray:
    """The Q bytes from each position, as one number."""
    n = len(clean) - Q + 1
    return np.ndarray((n,), "<u8", np.ascontiguousarray(clean), strides=(1,)) if n > 0 else np.empty(0, np.uint64)


def _terms(clean: bytes) -> tuple[int, int]:
    """Number of terms of a normalised text, and the hash of them all."""
    data = np.frombuffer(clean, np.uint8)
    _, _, hashes, first = K.words(data, np.array([0, len(data)]))
    return len(hashes), int(K.shingles(hashes, first, len(hashes))[0][0])


class Index:
    """Rare q-grams of a block of items with their places, and each item's edit budget and bound."""

    def __init__(self, items: list[tuple[int, str]], edits: float, min_chars: int):
        self.ids, self.text, self.budget = [], [], []
        self.short: dict[int, dict[int, list[tuple[int | None, bytes]]]] = {}
        for item_id, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            clean = normalised(raw, np.array([0, len(raw)]))[0].tobytes().strip()
            m = len(clean)
            if m < max(min_chars, Q):
                if m:
                    n, h = _terms(clean)
                    self.short.setdefault(n, {}).setdefault(h, []).append((item_id, clean))
                continue
            self.ids.append(item_id)
            self.text.append(clean)
            self.budget.append(max(0, min(int(edits * m), (m - Q + 1 - 4) // Q)))
        gram = [grams(np.frombuffer(t, np.uint8)) for t in self.text]
        value, count = np.unique(np.concatenate(gram), return_counts=True) if gram else (np.empty(0, np.uint64), np.empty(0, int))
        rows = []
        self.bound = np.zeros(len(gram), np.int64)
        for i, g in enumerate(gram):
            wanted = min(len(g), Q * self.budget[i] + max(4, len(g) // 3))
            rare = np.argsort(count[np.searchsorted(value, g)], kind="stable")[:wanted]
            self.bound[i] = wanted - Q * self.budget[i]
            rows.append(np.stack([g[rare], np.full(wanted, i, np.uint64), rare.astype(np.uint64)]))
        table = np.concatenate(rows, axis=1) if rows else np.empty((3, 0), np.uint64)
        table = table[:, np.argsort(table[0], kind="stable")]
        self.gram, self.start = np.unique(table[0], return_index=True)
        self.start = np.append(self.start, table.shape[1])
        self.item, self.at = table[1].astype(np.int64), table[2].astype(np.int64)
        self.budget = np.array(self.budget, np.int64)
        self.longest = max(map(len, self.text), default=0)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.gram * _ODD) >> np.uint64(64 - _BITS)] = True

    def bands(self, clean: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Rows (document, item, band) whose shared q-grams reach the item's bound."""
        g = grams(clean)
        if not len(g) or not len(self.gram):
            return np.empty((0, 3), np.int64)
        maybe = np.flatnonzero(self.seen[(g * _ODD) >> np.uint64(64 - _BITS)])
        place = np.minimum(np.searchsorted(self.gram, g[maybe]), len(self.gram) - 1)
        hit = self.gram[place] == g[maybe]
        where, place = maybe[hit], place[hit]
        doc = np.searchsorted(first, where, "right") - 1
        inside = where + Q <= first[doc + 1]
        where, place, doc = where[inside], place[inside], doc[inside]
        n = self.start[place + 1] - self.start[place]
        total = np.concatenate([[0], np.cumsum(n)])
        flat = np.repeat(self.start[place] - total[:-1], n) + np.arange(total[-1])
        item, where, doc = self.item[flat], np.repeat(where, n), np.repeat(doc, n)
        longest = self.longest
        band = (where - self.at[flat] + longest) // (self.budget[item] + 1)
        width = int(len(clean) + longest + 2)
        key = (doc * len(self.ids) + item) * width + band
        key, count = np.unique(np.concatenate([key, key - 1]), return_counts=True)
        item = key // width % len(self.ids)
        good = count >= self.bound[item]
        key, item = key[good], item[good]
        return np.stack([key // width // len(self.ids), item, key % width], axis=1)

    def exact(self, clean: np.ndarray, first: np.ndarray) -> list[tuple[int, int | None, bytes, int, int]]:
        """(document, item id, item, start, end) of the first place of each short item in each document."""
        out = []
        if not self.short:
            return out
        start, end, hashes, words = K.words(clean, first)
        owner = K.owners(words)
        for n, items in self.short.items():
            value, whole = K.shingles(hashes, words, n)
            wanted = np.array(list(items), np.uint64)
            told = set()
            for at in np.flatnonzero(whole & np.isin(value, wanted)).tolist():
                for item_id, text in items[int(value[at])]:
                    a, b, doc = int(start[at]), int(end[at + n - 1]), int(owner[at])
                    if (doc, item_id, text) not in told and clean[a:b].tobytes() == text:
                        told.add((doc, item_id, text))
                        out.append((doc, item_id, text, a, b))
        return out

    def verify(self, clean: np.ndarray, lo: int, hi: int, item: int, band: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the best occurrence of the item around the band, if within its budget."""
        text, e = self.text[item], int(self.budget[item])
        low = band * (e + 1) - self.longest - e
        high = low + 2 * (e + 1) + 2 * e
        a, b = max(lo, low), min(hi, high + len(text))
        found = clean[a:b].tobytes().find(text)
        if found >= 0:
            return 0, a + found, a + found + len(text)
        best = banded_alignment(clean, lo, hi, np.frombuffer(text, np.uint8), low, high) if e else None
        return best if best and best[0] <= e else None


def banded_alignment(clean, lo, hi, pattern, low, high) -> tuple[int, int, int] | None:
    """Fewest edits that turn the pattern into a stretch of clean[lo:hi], over the diagonals low to high.

    A cell is edits * 2**32 + start, so one minimum carries both; rows are vectors over the diagonals.
    """
    one, far = 1 << 32, 1 << 52
    diagonal = np.arange(low, high + 1)
    ramp = np.arange(len(diagonal), dtype=np.int64) * one
    cell = np.where((diagonal >= lo) & (diagonal <= hi), np.clip(diagonal, 0, None), far)
    padded = np.zeros(high + len(pattern) + 2 - low, np.int16) - 1
    a, b = max(lo, low), min(hi, high + len(pattern) + 1)
    if a >= b:
        return None
    padded[a - low : b - low] = clean[a:b]
    for r, byte in enumerate(pattern.tolist()):
        step = cell + np.where(padded[r : r + len(cell)] == byte, 0, one)
        step[:-1] = np.minimum(step[:-1], cell[1:] + one)
        end = diagonal + r + 1
        step = np.where((end >= lo) & (end <= hi), step, far)
        cell = np.minimum.accumulate(step - ramp) + ramp
    best = int(np.argmin(cell >> 32))
    edits = int(cell[best] >> 32)
    return (edits, int(cell[best] & (one - 1)), int(diagonal[best] + len(pattern))) if edits < len(pattern) else None


def occurrences(index: Index, texts: pa.Array) -> list[tuple[int, int | None, int, int, int, int]]:
    """(row, item id, item's length, edits, start byte, end byte) of each text and item: its occurrence with the fewest edits."""
    out = []
    for a, _, data, offsets in K.text_slices(texts):
        clean, first, place = normalised(data, offsets)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for doc, item, band in index.bands(clean, first).tolist():
            if best.get((doc, item), (1,))[0] == 0:
                continue
            found = index.verify(clean, int(first[doc]), int(first[doc + 1]), item, band)
            if found and (doc, item) not in best or found and found < best[doc, item]:
                best[doc, item] = found
        hits = [(doc, index.ids[item], index.text[item], *found) for (doc, item), found in best.items()]
        hits += [(doc, item_id, text, 0, start, end) for doc, item_id, text, start, end in index.exact(clean, first)]
        for doc, item_id, text, edits, start, end in hits:
            out.append((a + doc, item_id, len(text), edits, int(place[start] - offsets[doc]), int(place[end - 1] + 1 - offsets[doc])))
    return out


def item_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text"):
    """The items in lists of at most about BLOCK_CHARS characters, one list on the driver at a time."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(total // BLOCK_CHARS) + 1
    for i in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i) if blocks > 1 else items
        yield sorted(((r.item_id, r.text) for r in rows.distinct().collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])), i == blocks - 1


def contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = 0.08, min_chars: int = 30) -> DataFrame:
    """(doc_id, item_id, edits, similarity, start_byte, end_byte) of each document and item that occurs in it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    schema = "doc_id long, item_id long, edits int, similarity double, start_byte long, end_byte long"
    out = None
    for block, last in item_blocks(benchmark):
        index = docs.sparkSession.sparkContext.broadcast(Index(block, edits, min_chars))

        def run(batches, index=index):
            for batch in batches:
                found = occurrences(index.value, batch.column(1))
                r, item, size, e, start, end = (list(c) for c in zip(*found, strict=True)) if found else ([], [], [], [], [], [])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(r, pa.int64())),
                        pa.array(item, pa.int64()),
                        pa.array(e, pa.int32()),
                        pa.array([1 - n / m for n, m in zip(e, size, strict=True)], pa.float64()),
                        pa.array(start, pa.int64()),
                        pa.array(end, pa.int64()),
                    ],
                    ["doc_id", "item_id", "edits", "similarity", "start_byte", "end_byte"],
                )

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
        if not last:
            out = cut_lineage(out)
            index.unpersist()
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = 0.08, min_chars: int = 30) -> DataFrame:
    """The documents in which no item occurs, with all their columns."""
    names, at = docs.columns, docs.columns.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    for block, last in item_blocks(benchmark):
        index = docs.sparkSession.sparkContext.broadcast(Index(block, edits, min_chars))

        def run(batches, index=index):
            for batch in batches:
                mask = np.ones(batch.num_rows, bool)
                mask[[x[0] for x in occurrences(index.value, batch.column(at))]] = False
                yield batch.filter(pa.array(mask))

        plain = plain.mapInArrow(run, plain.schema)
        if not last:
            plain = cut_lineage(plain)
            index.unpersist()
    return plain.toDF(*names)
