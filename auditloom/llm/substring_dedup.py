"""Substring deduplication with difference-cover anchors.

A passage of at least `window` words that already starts in a document with a smaller id is removed
from the later document.

1. *Anchors.* With period v and difference cover D (every residue modulo v is a difference of two
   members), two equal runs of w + v - 1 words always hold one pair of aligned positions that both lie
   in D modulo v, so only windows of w = window - v + 1 words at cover positions are hashed: three of
   seven positions for windows of 13 words.
2. Anchors are shuffled by hash. Those found in two or more documents go back to their documents.
3. *Extension.* Around shared anchors, and nowhere else, each full window is hashed and shuffled; all
   of a later document's windows that start in an earlier one go back to it.
4. Words under such windows are cut out of the text.

Both shuffles stream sorted runs and remember one document per run, so a passage found in a third of
all documents needs no memory for its group. Nor does it fill one task: of a hash that LOCAL documents of
one slice of texts share, only the slice's first document is shuffled by hash; the others are known to
repeat it and are dealt out by document (`_dealt`). The text is shuffled once, by document, and that
exchange serves steps 3 and 4.

Defined cases: a null or empty text has no words; a text of any length is read whole. Fewer than `window`
words: nothing is removed. A null id is later than all others. Rows that repeat an id count as one document and
do not cut each other; nor do rows with null ids, which are held apart by a hash of their text, so that they are
never gathered as one document. The 2**32 largest ids stand for null. Other columns are carried through untouched under any name. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K

#: Ids from here on stand for null ones, told apart by a hash of their text.
NULL = (1 << 63) - (1 << 32)
#: So many documents of one slice with the same hash settle it among themselves.
LOCAL = 4
#: Hashes are even; the odd number after one marks a row that needs no comparison any more.
EVEN = np.uint64((1 << 64) - 2)


def difference_cover(period: int) -> list[int]:
    """A smallest set of residues among whose differences every residue occurs (searched up to 13, else built)."""
    if period <= 13:
        for size in range(1, period + 1):
            for rest in combinations(range(1, period), size - 1):
                cover = (0, *rest)
                if len({(a - b) % period for a in cover for b in cover}) == period:
                    return list(cover)
    step = int(np.ceil(np.sqrt(period)))
    return sorted({*range(step), *range(0, period, step), period - 1})


def plan(window: int) -> tuple[int, int, list[int]]:
    """Anchor length, period and cover for windows of `window` words; about half the window each."""
    period = max(1, (window + 1) // 2)
    return window - period + 1, period, difference_cover(period)


def _windows(hashes, first, length):
    """Even hashes of the runs of `length` words, and which of them are whole."""
    values, whole = K.shingles(hashes, first, length)
    return values & EVEN, whole


def _anchors(data, offsets, window):
    """Word spans, word hashes, documents' first words, and the anchors' word indexes and hashes."""
    length, period, cover = plan(window)
    start, end, hashes, first = K.words(data, offsets)
    n = np.diff(first)
    position = np.arange(len(start)) - np.repeat(first[:-1], n)
    anchor, whole = _windows(hashes, first, length)
    at = np.flatnonzero(whole & np.isin(position % period, cover) & (np.repeat(n, n) >= window))
    return start, end, hashes, first, at, anchor[at]


def _dealt(hashes: np.ndarray, doc: np.ndarray, keep_first: bool) -> pa.RecordBatch:
    """Rows (h, doc) of one slice, each once. Where LOCAL documents or more have a hash, all but its first
    are settled (and with keep_first the first as well): their h is odd. The first stays to be compared."""
    order = np.lexsort((doc, hashes))
    h, doc = K.signed(hashes)[order], doc[order]
    if len(h):
        once = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))
        h, doc = h[once], doc[once]
        starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        size = np.diff(np.append(starts, len(h)))
        # ids are sorted, so the last one tells whether null ones, which do not cut each other, are among them
        many = (size >= LOCAL) & (doc[starts + size - 1] < NULL)
        settled = np.repeat(many, size)
        heads = starts[many]
        settled[heads] = keep_first
        again = heads if keep_first else heads[:0]
        h, doc = np.concatenate([h + settled, h[again]]), np.concatenate([doc, doc[again]])
    return pa.RecordBatch.from_arrays([pa.array(h), pa.array(doc)], ["h", "doc"])


def _shared(keep_first: bool):
    """Over rows (h, doc) sorted by both: the rows of each h that two documents or more have.

    With keep_first the rows of a run's smallest document belong to the result, else only later ones.
    Settled rows belong to it in any case. The first document of the open run is carried from batch to batch; its rows are repeated at most once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_h, last_doc, told = None, None, False
        for batch in batches:
            h, doc = (batch.column(i).to_numpy() for i in (0, 1))
            settled = (h & 1).astype(bool)
            if settled.any():
                yield pa.RecordBatch.from_arrays([pa.array(h[settled] - 1), pa.array(doc[settled])], ["h", "doc"])
                h, doc = h[~settled], doc[~settled]
            if not len(h):
                continue
            new = np.empty(len(h), bool)
            new[0], new[1:] = h[0] != last_h, h[1:] != h[:-1]
            run_id = np.cumsum(new) - 1  # -1: goes on from the batch before
            least = doc[new]
            least = np.concatenate([[last_doc if last_doc is not None else 0], least])[run_id + 1]
            later = np.minimum(doc, NULL) != np.minimum(least, NULL)
            out_h, out_doc = h[later], doc[later]
            if keep_first:
                ids = np.unique(run_id[later])
                if len(ids) and ids[0] == -1 and told:
                    ids = ids[1:]
                firsts = np.flatnonzero(new)
                own = np.where(ids < 0, 0, firsts[np.maximum(ids, 0)] if len(firsts) else 0)
                out_h = np.concatenate([out_h, h[own]])
                out_doc = np.concatenate([out_doc, least[own]])
            told = bool(later[run_id == run_id[-1]].any()) or (told and run_id[-1] == -1)
            last_h, last_doc = h[-1], least[-1]
            yield pa.RecordBatch.from_arrays([pa.array(out_h), pa.array(out_doc)], ["h", "doc"])

    return run


def _by_document(rows: DataFrame, keep_first: bool, name: str) -> DataFrame:
    """(doc, list of hashes) of the hashes that several documents have."""
    dealt_by = F.when(F.col("h").bitwiseAND(F.lit(1)) == 1, F.xxhash64("h", "doc")).otherwise(F.col("h"))
    found = rows.repartition(dealt_by).sortWithinPartitions("h", "doc").mapInArrow(_shared(keep_first), "h long, doc long")
    return found.groupBy("doc").agg(F.collect_set("h").alias(name))


def _listed(column: pa.Array, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column's rows a to b, and each value's row."""
    part = column.slice(a, b - a)
    lengths = np.nan_to_num(part.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return part.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.repeat(np.arange(b - a), lengths)


def _member(hashes, rows, listed, listed_rows) -> np.ndarray:
    """Whether each hash is in its own row's list."""
    salt = K.mix(np.arange(max([0, *rows[-1:], *listed_rows[-1:]]) + 1, dtype=np.uint64))
    return np.isin(hashes ^ salt[rows], listed ^ salt[listed_rows])


def _emit_anchors(window):
    def run(batches):
        for batch in batches:
            doc = batch.column(0).to_numpy()
            for a, _, data, offsets in K.text_slices(batch.column(1)):
                *_, first, at, anchor = _anchors(data, offsets, window)
                key = doc[a + K.owners(first)[at]]
                yield _dealt(anchor, key, True)

    return run


def _emit_windows(window):
    _, period, _ = plan(window)

    def run(batches):
        for batch in batches:
            doc = batch.column(0).to_numpy()
            for a, b, data, offsets in K.text_slices(batch.column(1)):
                _, _, hashes, first, at, anchor = _anchors(data, offsets, window)
                owner = K.owners(first)
                hot = at[_member(anchor, owner[at], *_listed(batch.column(2), a, b))]
                near = np.zeros(len(hashes) + 1, np.int64)  # windows that start up to period - 1 words before a hot anchor
                np.add.at(near, np.maximum(hot - period + 1, first[owner[hot]]), 1)
                np.add.at(near, hot + 1, -1)
                full, whole = _windows(hashes, first, window)
                take = (np.cumsum(near)[:-1] > 0) & whole
                yield _dealt(full[take], doc[a + owner[take]], False)

    return run


def covered_words(data, offsets, listed, listed_rows, window):
    """Word spans, each document's first word, and whether a listed window covers the word."""
    start, end, hashes, first = K.words(data, offsets)
    owner = K.owners(first)
    full, whole = _windows(hashes, first, window)
    at = np.flatnonzero(whole)
    hit = at[_member(full[at], owner[at], listed, listed_rows)] if len(listed) else at[:0]
    edge = np.zeros(len(start) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + window, -1)
    return start, end, first, np.cumsum(edge)[:-1] > 0


def _digest(window):
    def run(batches):
        for batch in batches:
            out = []
            for a, b, data, offsets in K.text_slices(batch.column(1)):
                start, end, first, gone = covered_words(data, offsets, *_listed(batch.column(2), a, b), window)
                removed = K.sums(gone.astype(np.int64), first)
                for i in range(b - a):
                    keep = np.flatnonzero(~gone[first[i] : first[i + 1]]) + first[i]
                    kept = _joined(data, start[keep], end[keep])
                    out.append((int(first[i + 1] - first[i]), int(removed[i]), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return run


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """The given words joined by one space."""
    if not len(start):
        return b""
    mark = np.zeros(int(end[-1] - start[0]) + 1, np.int8)
    mark[start - start[0]] += 1
    mark[end - start[0]] -= 1
    inside = np.cumsum(mark[:-1]).astype(bool)
    inside[end[:-1] - start[0]] = True  # the byte after a word stands for the space
    out = data[start[0] : end[-1]].copy()
    out[end[:-1] - start[0]] = 32
    return out[inside].tobytes()


def _cut(text_at: int, n_columns: int, window: int, size_at: int | None):
    """Texts without the covered words; texts that nothing covers stay byte for byte."""

    def run(batches):
        for batch in batches:
            texts = batch.column(text_at)
            new, changed, keep = texts.to_pylist(), [], []
            for a, b, data, offsets in K.text_slices(texts):
                start, _, first, gone = covered_words(data, offsets, *_listed(batch.column(n_columns), a, b), window)
                removed = K.sums(gone.astype(np.int64), first)
                for i in np.flatnonzero(removed):
                    lo, hi = first[i], first[i + 1]
                    stay = np.ones(int(offsets[i + 1] - offsets[i]), bool)
                    edges = np.append(start[lo:hi], offsets[i + 1]) - offsets[i]
                    mark = np.zeros(len(stay) + 1, np.int64)
                    which = np.flatnonzero(gone[lo:hi])
                    np.add.at(mark, edges[which], 1)
                    np.add.at(mark, edges[which + 1], -1)
                    stay &= np.cumsum(mark)[:-1] == 0
                    new[a + i] = data[offsets[i] : offsets[i + 1]][stay].tobytes().decode("utf-8", "replace")
                    changed.append(a + i)
                    if removed[i] == hi - lo:
                        keep.append(a + i)
            mask = np.ones(len(new), bool)
            mask[keep] = False
            columns = [batch.column(i) for i in range(n_columns)]
            columns[text_at] = pa.array(new, texts.type)
            if size_at is not None and changed:
                sizes = columns[size_at].to_pylist()
                for i in changed:
                    sizes[i] = len(new[i])
                columns[size_at] = pa.array(sizes, columns[size_at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:n_columns]).filter(pa.array(mask))

    return run


def _document(doc_id: Column, text: Column) -> Column:
    # never null, also to the optimizer: a null filter on one side only would keep the exchange from being reused
    return F.coalesce(doc_id.cast("long"), F.xxhash64(text).bitwiseAND(F.lit((1 << 32) - 1)).bitwiseOR(F.lit(NULL)))


def _removals(docs: DataFrame, window: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The documents keyed by id, and (doc, windows to remove)."""
    keyed = docs.select(_document(F.col(id_col), F.col(text_col)).alias("doc"), F.col(text_col).cast("string").alias("text"))
    anchors = keyed.mapInArrow(_emit_anchors(window), "h long, doc long")
    hot = _by_document(anchors, True, "hot")
    windows = keyed.join(hot, "doc").select("doc", "text", "hot").mapInArrow(_emit_windows(window), "h long, doc long")
    return keyed, _by_document(windows, False, "gone")


def substring_digest(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    keyed, gone = _removals(docs, window, id_col, text_col)
    joined = keyed.join(gone, "doc", "left").select("doc", "text", "gone")
    out = joined.mapInArrow(_digest(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") < NULL, F.col("doc_id")))


def substring_dedup(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """The documents with repeated passages cut out of the text, white space kept as it was.

    `size_col`, if the table has it, is set to the new number of characters of changed texts. A
    document all of whose words repeat earlier ones is dropped; one that had no words stays.
    """
    names = docs.columns
    _, gone = _removals(docs, window, id_col, text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key = _document(plain[names.index(id_col)], plain[names.index(text_col)])
    joined = plain.withColumn("doc", key).join(gone, "doc", "left").select(*plain.columns, "gone")
    size_at = names.index(size_col) if size_col in names else None
    cut = joined.mapInArrow(_cut(names.index(text_col), len(names), window, size_at), plain.schema)
    return cut.toDF(*names)
