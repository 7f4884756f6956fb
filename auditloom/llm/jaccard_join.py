"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of shingles of `k` words; two texts are linked if their Jaccard similarity is at least
`threshold`.

1. Equal texts become one. Each distinct text gets HASHES MinHash values.
2. Candidates: texts that agree on a band of ROWS values. At similarity 0.8 a pair shares one of the 24
   bands with probability 1 - 3e-6. Bands with many texts are dealt over blocks of at most BLOCK texts and
   every pair of blocks is a group of its own, so no group is larger than two blocks.
3. Pruning: a candidate pair's values are compared in steps; after each step the posterior of the similarity
   (uniform prior, so a Beta distribution) says how probable it is to reach the threshold, and the pair is
   dropped when that falls below `tolerance`. A pair is examined only in the first band that it shares.
4. Verification: the rest is compared on whole shingle sets. Only texts with a pair left are fetched.
5. Groups give back one row for each of their texts: its number of links and its local component. Pairs are
   never written out. Components are merged over all groups; a class is a component of linked texts. Texts and
   classes with very many rows meet their values by broadcast (`shared.join_hot`), not in one task.

Defined cases: a null text, or one without a word, has no shingles: it is linked to nothing and a class of
its own. A text of any length is read whole. A text of fewer than `k` words has one shingle, all its words. Copies of a text share its class and
its links; n_links counts other texts, n_copies other rows of the same text. The class id is the smallest id
of the class (null ids count as the largest). Extra columns are carried through by `drop_near_duplicates`,
which keeps rows that repeat both id and text once. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import cut_lineage, join_hot, min_labels

HASHES, ROWS, STEP, BLOCK = 96, 4, 16, 256
BANDS = HASHES // ROWS
LAST = (1 << 63) - 1
_rng = np.random.Generator(np.random.PCG64(8))
_XOR = _rng.integers(0, 2**64, HASHES, dtype=np.uint64)
_MUL = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's shingles, repeats included, and each document's first one."""
    _, _, hashes, first = K.words(data, offsets)
    whole, ok = K.shingles(hashes, first, k)
    n = np.diff(first)
    at = [np.flatnonzero(ok)]
    for short in range(1, k):
        docs = np.flatnonzero(n == short)
        if len(docs):
            whole[first[docs]] = K.shingles(hashes, first, short)[0][first[docs]]
            at.append(first[docs])
    at = np.sort(np.concatenate(at))
    return whole[at], np.searchsorted(at, first)


def signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """HASHES values for each document that has shingles."""
    start = first[:-1][np.diff(first) > 0]
    out = np.empty((len(start), HASHES), np.uint32)
    if len(start):
        for j in range(HASHES):
            out[:, j] = np.minimum.reduceat((hashes ^ _XOR[j]) * _MUL[j], start) >> np.uint64(32)
    return out


def needed_matches(threshold: float, tolerance: float) -> np.ndarray:
    """After each step of STEP values, the fewest equal ones at which the pair stays.

    With m of n equal the similarity is Beta(m + 1, n - m + 1), whose probability above the threshold t is
    that of at most m successes in n + 1 trials of chance t.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        chance = 0.0
        for m in range(n + 1):
            chance += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if chance >= tolerance:
                out.append(m)
                break
    return np.array(out)


def _fixed(column: pa.Array, width: int, kind) -> np.ndarray:
    """A binary column of equal widths as a matrix."""
    data, offsets = K.text_buffers(column)
    return np.ascontiguousarray(data).view(kind).reshape(len(offsets) - 1, width) if len(data) else np.empty((0, width), kind)


def _binary(matrix: np.ndarray) -> pa.Array:
    width = matrix.shape[1] * matrix.itemsize
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(matrix))])


def _sign(k: int):
    """(text, ...) -> digest of the text and signature, for texts with a word."""

    def run(batches):
        for batch in batches:
            doc = batch.column(0)
            for a, b, data, offsets in K.text_slices(batch.column(1)):
                hashes, first = shingle_hashes(data, offsets, k)
                some = np.flatnonzero(np.diff(first))
                digest = [hashlib.md5(data[offsets[i] : offsets[i + 1]]).digest() for i in some]
                yield pa.RecordBatch.from_arrays([doc.slice(a, b - a).take(pa.array(some)), pa.array(digest, pa.binary()), _binary(signatures(hashes, first))], ["doc", "t", "sig"])

    return run


def _bands(batches):
    for batch in batches:
        sig = _fixed(batch.column(1), HASHES, np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = np.zeros(sig.shape[:2], np.uint64)
        for r in range(ROWS):
            key = K.mix(key + sig[:, :, r] + np.uint64(0x9E3779B97F4A7C15))
        key = K.mix(key + np.arange(BANDS, dtype=np.uint64))
        rows = np.repeat(np.arange(len(sig)), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(K.signed(key.ravel())), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(sig))), batch.column(0).take(pa.array(rows))], ["band", "nth", "t"])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by their first `keys` columns, in batches that hold whole groups, with group numbers."""
    held = None
    for batch in chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks()
            held = table.to_batches()[0]
        elif held is None:
            return
        new = np.zeros(held.num_rows, bool)
        for i in range(keys):
            v = held.column(i).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        whole = int(np.flatnonzero(new)[-1]) if batch is not None and new.any() else 0 if batch is not None else held.num_rows
        if whole:
            yield held.slice(0, whole), np.cumsum(new[:whole])
        held = held.slice(whole)


def surviving_pairs(group: np.ndarray, side: np.ndarray, crossed: np.ndarray, nth: np.ndarray, sig: np.ndarray, need: np.ndarray):
    """Index pairs (i, j) of the same group that pass the pruning and share no earlier band.

    In a crossed group only rows of different sides are paired; sides are sorted within the group.
    """
    size = np.bincount(group) if len(group) else np.zeros(1, int)
    for lag in range(1, int(size.max(initial=0))):
        i = np.flatnonzero(group[:-lag] == group[lag:])
        j = i + lag
        fit = ~crossed[i] | (side[i] != side[j])
        i, j = i[fit], j[fit]
        equal = np.zeros(len(i), np.int64)
        for step, least in enumerate(need):
            if not len(i):
                break
            same = sig[i, step * STEP : (step + 1) * STEP] == sig[j, step * STEP : (step + 1) * STEP]
            equal += same.sum(axis=1)
            shared = same.reshape(len(i), STEP // ROWS, ROWS).all(axis=2) & (np.arange(STEP // ROWS) + step * (STEP // ROWS) < nth[i][:, None])
            stay = (equal >= least) & ~shared.any(axis=1)
            i, j, equal = i[stay], j[stay], equal[stay]
        if len(i):
            yield i, j


def _prune(need):
    """Rows (band, s1, s2, side, nth, t, sig) -> those with a pair left, without the signature."""

    def run(batches):
        for rows, group in _groups(batches, 3):
            s1, s2, side, nth = (rows.column(c).to_numpy() for c in (1, 2, 3, 4))
            left = np.zeros(rows.num_rows, bool)
            for i, j in surviving_pairs(group, side, s1 != s2, nth, _fixed(rows.column(6), HASHES, np.uint32), need):
                left[i] = left[j] = True
            yield rows.select([0, 1, 2, 3, 4, 5]).filter(pa.array(left))

    return run


def _sets(k: int):
    """Rows (band, s1, s2, side, nth, t, text) -> the same with signature and sorted shingle set."""

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in K.text_slices(batch.column(6)):
                hashes, first = shingle_hashes(data, offsets, k)
                order = np.lexsort((hashes, K.owners(first)))
                hashes = hashes[order]
                new = np.ones(len(hashes), bool)
                new[1:] = hashes[1:] != hashes[:-1]
                new[first[:-1]] = True
                count = K.sums(new.astype(np.int64), first)
                ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32) * 8
                values = np.ascontiguousarray(hashes[new])
                packed = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends), pa.py_buffer(values)])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(6)), _binary(signatures(hashes, first)), packed], ["band", "s1", "s2", "side", "nth", "t", "sig", "items"])

    return run


def linked(i: np.ndarray, j: np.ndarray, values: np.ndarray, first: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each pair's sets reach the threshold, by exact intersection sizes."""
    size = np.diff(first)
    out = np.zeros(len(i), bool)
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else []
    for a, b in zip(starts, [*starts[1:], len(i)], strict=True):
        own = values[first[i[a]] : first[i[a] + 1]]
        for at in range(a, b):
            other = values[first[j[at]] : first[j[at] + 1]]
            if min(len(own), len(other)) < threshold * max(len(own), len(other)):
                continue
            place = np.searchsorted(own, other)
            common = int((own[np.minimum(place, len(own) - 1)] == other).sum())
            out[order[at]] = common >= threshold * (size[i[a]] + size[j[at]] - common) - 1e-9
    return out


def _verify(need, threshold):
    """Rows with signature and set -> (t, root, n_links) within each group."""

    def run(batches):
        for rows, group in _groups(batches, 3):
            s1, s2, side, nth = (rows.column(c).to_numpy() for c in (1, 2, 3, 4))
            data, offsets = K.text_buffers(rows.column(7))
            values = np.ascontiguousarray(data).view(np.uint64)
            links = np.zeros(rows.num_rows, np.int64)
            root = np.arange(rows.num_rows)
            for i, j in surviving_pairs(group, side, s1 != s2, nth, _fixed(rows.column(6), HASHES, np.uint32), need):
                yes = linked(i, j, values, offsets // 8, threshold)
                i, j = i[yes], j[yes]
                np.add.at(links, i, 1)
                np.add.at(links, j, 1)
                for a, b in zip(i.tolist(), j.tolist(), strict=True):
                    while root[a] != a:
                        root[a] = a = root[root[a]]
                    while root[b] != b:
                        root[b] = b = root[root[b]]
                    root[max(a, b)] = min(a, b)
            while (root != root[root]).any():
                root = root[root]
            some = np.flatnonzero(links)
            t = rows.column(5)
            yield pa.RecordBatch.from_arrays([t.take(pa.array(some)), t.take(pa.array(root[some])), pa.array(links[some])], ["t", "root", "n_links"])

    return run


def _link_table(docs: DataFrame, k: int, threshold: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """(doc, t) of documents with a word, and (t, comp, n_links) of linked texts."""
    need = needed_matches(threshold, tolerance)
    keyed = docs.select(F.col("doc"), F.coalesce("text", F.lit("")).alias("text"))
    signed = cut_lineage(keyed.mapInArrow(_sign(k), "doc long, t binary, sig binary"))
    texts = signed.groupBy("t").agg(F.first("sig").alias("sig"))
    bands = texts.select("t", "sig").mapInArrow(_bands, "band long, nth int, t binary")
    full = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    salted = bands.join(full, "band").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    salted = salted.withColumn("side", F.pmod(F.xxhash64("t"), F.col("blocks")).cast("int"))
    # a text of block s meets every block: once as the pair (s, s), else as the pair of both, smaller first
    salted = salted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    grouped = salted.select("band", F.least("side", "other").alias("s1"), F.greatest("side", "other").alias("s2"), "side", "nth", "t")
    key, order = ("band", "s1", "s2"), ("band", "s1", "s2", "side", "t")
    schema = "band long, s1 int, s2 int, side int, nth int, t binary"
    pruned = grouped.join(texts, "t").select(*key, "side", "nth", "t", "sig").repartition(*key).sortWithinPartitions(*order).mapInArrow(_prune(need), schema)
    whole = keyed.withColumn("t", F.unhex(F.md5(F.col("text").cast("binary")))).groupBy("t").agg(F.first("text").alias("text"))
    filled = cut_lineage(pruned).join(whole, "t").select(*key, "side", "nth", "t", "text").mapInArrow(_sets(k), schema + ", sig binary, items binary")
    found = filled.repartition(*key).sortWithinPartitions(*order).mapInArrow(_verify(need, threshold), "t binary, root binary, n_links long")
    found = cut_lineage(found.select(F.hex("t").alias("t"), F.hex("root").alias("root"), "n_links"))
    links = found.groupBy("t").agg(F.sum("n_links").alias("n_links"))
    comps = min_labels(found.select(F.col("t").alias("a"), F.col("root").alias("b")))
    return signed.select("doc", F.hex("t").alias("t")), links.join(comps.withColumnRenamed("node", "t"), "t").select("t", F.col("label").alias("comp"), "n_links")


def _classes(docs: DataFrame, k: int, threshold: float, tolerance: float) -> DataFrame:
    """(doc, t, comp, n_links, n_copies, class_doc, class_t) of documents with a word."""
    members, links = _link_table(docs, k, threshold, tolerance)
    texts = members.groupBy("t").agg(F.min("doc").alias("least"), F.count("*").alias("n"))
    texts = texts.join(links, "t", "left").withColumn("comp", F.coalesce("comp", "t"))
    heads = texts.groupBy("comp").agg(F.min(F.struct("least", "t")).alias("head"))
    texts = texts.join(heads, "comp")
    texts = cut_lineage(texts.select("t", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.col("n") - 1).alias("n_copies"), F.col("head.least").alias("class_doc"), F.col("head.t").alias("class_t")))
    return join_hot(members, texts, "t")


def near_duplicate_classes(docs: DataFrame, k: int = 5, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """Per document doc_id, class_id, n_links (other texts at least `threshold` similar) and n_copies."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.col("text").alias("text"))
    found = _classes(keyed, k, threshold, tolerance).select("doc", "class_doc", "n_links", "n_copies")
    empty = keyed.where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    zero = F.lit(0).cast("long")
    both = found.union(empty.select("doc", F.col("doc").alias("class_doc"), zero, zero))
    null = F.lit(LAST)
    return both.select(F.nullif("doc", null).alias("doc_id"), F.nullif("class_doc", null).alias("class_id"), "n_links", "n_copies")


def drop_near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """The documents of which no other one stays: the one with the smallest id of each class, all columns."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = F.coalesce(F.col(f"c{names.index('text')}"), F.lit(""))
    doc = F.coalesce(F.col(f"c{names.index('doc_id')}").cast("long"), F.lit(LAST))
    found = _classes(plain.select(doc.alias("doc"), text.alias("text")), k, threshold, tolerance)
    gone = found.where("doc <> class_doc OR t <> class_t").select("doc", "t").distinct()
    keyed = plain.withColumn("t", F.upper(F.md5(text.cast("binary")))).withColumn("doc", doc)
    return keyed.join(gone, ["doc", "t"], "left_anti").dropDuplicates(["doc", "t"]).select(*plain.columns).toDF(*names)
