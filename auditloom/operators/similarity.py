"""Exact and near duplicates and near misses in spelling."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .graph import cut_lineage
from .sized import SMALL_ROWS, sized_join

HASHES, BANDS, THRESHOLD, BLOCK = 96, 12, 0.90, 256
_rng = random.Random(7)
#: Seeds that a 32-bit hash is combined with, drawn from a fixed generator so that signatures are reproducible.
SEEDS = [_rng.getrandbits(32) for _ in range(HASHES)]


def exact_copies(rows: DataFrame, text: Column) -> DataFrame:
    """The rows with a key of their text and the number of rows that share it."""
    keyed = rows.withColumn("text_key", F.md5(F.lower(text).cast("binary")))
    # counts are partial sums, and rows of a frequent text stay where they are
    return sized_join(keyed, keyed.groupBy("text_key").agg(F.count("*").alias("n_copies")), "text_key")


def shingle_hashes_md5(words: Column, k: int = 5) -> Column:
    """Distinct 32-bit hashes of the k-word shingles, of the whole text if it is shorter: the first md5 digits."""
    n = F.greatest(F.lit(1), F.size(words) - (k - 1))
    parts = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(words, i, k), " "))
    return F.array_distinct(F.transform(parts, lambda s: F.conv(F.substring(F.md5(s.cast("binary")), 1, 8), 16, 10).cast("long")))


def shingle_hashes_crc32(words: Column, k: int = 5) -> Column:
    """The same by the crc32 of each shingle."""
    n = F.greatest(F.lit(1), F.size(words) - (k - 1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.crc32(F.array_join(F.slice(words, i, k), " ").cast("binary"))))


@F.pandas_udf(ArrayType(LongType()))
def signature(hashes: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """For each seed the smallest exclusive-or of a hash with it: Arrow batches in, numpy inside."""
    seeds = np.array(SEEDS, np.int64)
    for batch in hashes:
        yield pd.Series([(np.asarray(h, np.int64)[:, None] ^ seeds).min(axis=0) if h is not None and len(h) else None for h in batch])


def near_pairs(signed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity) of different signatures of (id, sig) that agree on at least `threshold` of their values.

    Rows with equal signatures form a class, named by its smallest id; pairs are between classes, so copies are
    never multiplied (`members` has them all). Candidates share a band of 8 of the 96 values. Pairs at 0.90 differ in
    9 values at most and those spoil 9 of the 12 bands at most, so no pair is lost. Bands travel without signatures,
    and one with many classes is dealt over pairs of blocks of BLOCK classes; signatures are fetched once for a pair.
    """
    classes = cut_lineage(signed.groupBy("sig").agg(F.min("id").alias("rep")))
    size = HASHES // BANDS
    key = lambda b: F.xxhash64(b, F.array_join(F.slice("sig", b * size + 1, size), ","))
    bands = classes.select("rep", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), key)).alias("band"))
    full = bands.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    dealt = bands.join(full, "band").withColumn("side", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", F.least("side", "other").alias("s1"), F.greatest("side", "other").alias("s2"), "side", "rep")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("band", "s1", "s2")]
    apart = (F.col("x.rep") < F.col("y.rep")) & ((F.col("x.s1") == F.col("x.s2")) | (F.col("x.side") != F.col("y.side")))
    pairs = dealt.alias("x").join(dealt.alias("y"), same[0] & same[1] & same[2] & apart).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    both = pairs.join(classes.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a").join(classes.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
    equal = F.aggregate(F.zip_with("sa", "sb", lambda p, q: F.when(p == q, 1).otherwise(0)), F.lit(0), lambda s, v: s + v)
    return both.withColumn("similarity", equal / F.lit(float(HASHES))).where(F.col("similarity") >= threshold).select("a", "b", "similarity")


def members(signed: DataFrame) -> DataFrame:
    """(id, rep): for every signed row of (id, sig) the class that `near_pairs` counts it in, its own id if it is alone.

    With the pairs this is the whole result: all rows of one class agree on every value, and each row of a class is
    as similar to each row of a paired class as the pair says. Each row is written once, so copies are not multiplied.
    """
    # rows without a signature are dropped once it is made: a filter before that would make it, and split the text anew for every shingle
    keyed = cut_lineage(signed.select("id", F.sha2(F.array_join("sig", ",").cast("binary"), 256).alias("key"))).where("key IS NOT NULL")
    return keyed.join(keyed.groupBy("key").agg(F.min("id").alias("rep")), "key").select("id", "rep")


#: An odd number from the same generator, by which the hash of a word is multiplied for each letter.
BASE = np.uint64(_rng.getrandbits(64) | 1)


def _deletions(codes: np.ndarray, most: int, start: int = 0) -> Iterator[np.ndarray]:
    """Hashes of the words of `codes`, a row of code points each, with 0 to `most` letters left out from `start` on."""
    yield _hashed(codes)
    if most:
        for cut in range(start, codes.shape[1]):
            # the next letter to go is behind this one, so that no choice comes twice
            yield from _deletions(np.delete(codes, cut, axis=1), most - 1, cut)


def _hashed(codes: np.ndarray) -> np.ndarray:
    out = np.full(len(codes), codes.shape[1], np.uint64)
    for letter in codes.T:
        out = (out ^ (out >> np.uint64(29))) * BASE + letter
    return out ^ (out >> np.uint64(32))


def deletion_keys(distance: int):
    """A column of 64-bit keys of a word: one for each different word that is left when up to `distance` letters go."""

    @F.pandas_udf(ArrayType(LongType()))
    def keys(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in words:
            out = np.empty(len(batch), object)
            sizes = batch.str.len().to_numpy()
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                codes = np.array([[ord(c) for c in w] for w in batch.iloc[rows]], np.uint64).reshape(len(rows), size)
                found = np.sort(np.stack(list(_deletions(codes, distance)), axis=1), axis=1)
                fresh = np.ones(found.shape, bool)
                fresh[:, 1:] = found[:, 1:] != found[:, :-1]
                for row, at in enumerate(rows):
                    out[at] = found[row][fresh[row]].view(np.int64)
            yield pd.Series(out, index=batch.index)

    return keys


def near_misses(words: DataFrame, distance: int = 1, known: DataFrame | None = None) -> DataFrame:
    """(word, suggestion, distance) of words at most `distance` edits apart, rarer word first.

    words: word, n; suggestions come from `known`, the same columns, or from `words` themselves. Two words within d
    edits become equal when at most d letters are deleted from each, so all words with up to d deletions meet in an
    equi-join of their 64-bit hashes; the distance is then checked, before pairs are shuffled, so that neither a hash
    that two words share nor a far pair goes further. This is exact for every distance.
    """

    keyed = lambda rows: rows.where("word IS NOT NULL").select("word", "n", F.explode(deletion_keys(distance)("word")).alias("key"))
    known = words if known is None else known
    side = keyed(known)
    if known.limit(SMALL_ROWS // 100 + 1).count() <= SMALL_ROWS // 100:  # a word has up to 172 keys
        side = F.broadcast(side)
    pairs = keyed(words).alias("x").join(side.alias("y"), F.col("x.key") == F.col("y.key")).where((F.col("x.n") < F.col("y.n")) & (F.col("x.word") != F.col("y.word")))
    pairs = pairs.select(F.col("x.word").alias("word"), F.col("y.word").alias("suggestion"), F.levenshtein("x.word", "y.word", distance).cast("long").alias("distance"))
    return pairs.where(F.col("distance") >= 0).distinct()
