"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Terms are runs of letters, digits and non-ASCII characters, ASCII letters lower-cased. Features are
single terms, pairs of neighbours and pairs that skip one term, hashed into 2**bits coordinates; a
feature counts once per document.

Training: up to `max_rows` labelled documents (those with the smallest hashed ids: a documented bound,
the same rows on every run) are dealt over tasks of about `shard_rows` each, a range of shards for each task,
in the order of their hashes. Each runs FTRL-proximal with per-coordinate rates and L1 sparsity for a few
passes; the shards' weights are averaged per coordinate, added in the order of the shards. L1 leaves a few
hundred to a few thousand coordinates: these, with their weights, are the model that is broadcast. Scoring is one
pass over whole texts without a shuffle.

Defined cases: a null or empty text has no features and gets the score of the bias alone; a text of any length is
read whole. Labels other than 0 and 1, or null, and null ids are not learned from; a document labelled twice is
learned from twice; an id that several rows carry is learned from once, by the text with the least hash. Without
any usable label every score is 0.5, which `predicted` counts as 1, and the filter keeps everything, for lack of
evidence; with one, the filter drops what `predicted` counts as 1. Extra columns are not read; the filter carries
them through. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K

_PAIR, _SKIP = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of each document's distinct features, and each document's first one."""
    data = K.LOWER[data]
    start, end, first = K.spans(K.IS_TERM[data], offsets)
    one = K.span_hash(K.prefix_hash(data), start, end)
    owner = K.owners(first)
    parts, docs = [one], [owner]
    for gap, salt in ((1, _PAIR), (2, _SKIP)):
        same = owner[gap:] == owner[:-gap] if len(owner) > gap else np.zeros(0, bool)
        if same.any():
            parts.append(K.mix(one[:-gap][same] * salt + one[gap:][same]))
            docs.append(owner[gap:][same])
    n = len(offsets) - 1
    key = (np.concatenate(docs).astype(np.int64) << bits) | (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64)
    key = np.unique(key)
    return key & ((1 << bits) - 1), np.searchsorted(key, np.arange(n + 1, dtype=np.int64) << bits)


def probability(weights: np.ndarray, bias: float, coordinates: np.ndarray, first: np.ndarray) -> np.ndarray:
    logit = K.sums(weights[coordinates].astype(np.float64), first) + bias
    return 1 / (1 + np.exp(-np.clip(logit, -35, 35)))


def ftrl(coordinates, first, labels, bits, alpha, beta, l1, l2, passes) -> tuple[np.ndarray, float]:
    """Weights and bias after FTRL-proximal passes over the documents in the given order."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias_z = bias_n = 0.0

    def weight(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(passes):
        for i, y in enumerate(labels):
            at = coordinates[first[i] : first[i + 1]]
            w = weight(z[at], n[at])
            b = -bias_z / ((beta + np.sqrt(bias_n)) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
            g = p - y
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / alpha * b
            bias_n += g * g
    return weight(z, n), -bias_z / ((beta + np.sqrt(bias_n)) / alpha)


@dataclass(frozen=True)
class Model:
    """The coordinates with a weight, and the bias; `trained` tells whether there was any label."""

    at: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int
    trained: bool

    def scores(self, texts: pa.Array) -> np.ndarray:
        dense = np.zeros(1 << self.bits, np.float32)
        dense[self.at] = self.weights
        out = [probability(dense, self.bias, *features(data, offsets, self.bits)) for _, _, data, offsets in K.text_slices(texts)]
        return np.concatenate(out) if out else np.empty(0)


def train(docs: DataFrame, marks: DataFrame, bits: int = 18, max_rows: int = 24_000, shard_rows: int = 4_000, alpha: float = 2.0, beta: float = 1.0, l1: float = 12.0, l2: float = 0.0, passes: int = 4) -> Model:
    """The averaged model of texts (doc_id, text) and their marks (doc_id, label)."""
    usable = marks.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    usable = usable.select("doc_id", F.col("label").cast("int").alias("label"), F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)).alias("o"))
    # at most max_rows narrow rows, so the texts need no shuffle to meet them
    sample = F.broadcast(usable.orderBy("o", "label", "doc_id").limit(max_rows))
    shards = max(1, round(usable.limit(max_rows).count() / shard_rows))
    text = F.coalesce("text", F.lit(""))
    one = docs.select("doc_id", text.alias("text")).join(sample.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    dealt = one.join(sample, "doc_id").withColumn("shard", F.pmod(F.col("o"), F.lit(shards)).cast("int")).select("shard", "o", "label", "text")
    dealt = dealt.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "o", "label", F.xxhash64("text"))

    def fit(batches):
        shard, parts, lengths, labels = None, [], [], []

        def done():
            first = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int64)
            w, b = ftrl(np.concatenate(parts), first, np.concatenate(labels), bits, alpha, beta, l1, l2, passes)
            at = np.flatnonzero(w)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at) + 1, shard, np.int32)), pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(w[at], b))], ["shard", "at", "w"])

        for batch in batches:
            key = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            for a, b in zip(edges, [*edges[1:], len(key)], strict=True):
                if shard is not None and key[a] != shard:
                    yield done()
                    parts, lengths, labels = [], [], []
                shard = int(key[a])
                labels.append(batch.column(2).slice(a, b - a).to_numpy())
                for _, _, data, offsets in K.text_slices(batch.column(3).slice(a, b - a)):
                    at, first = features(data, offsets, bits)
                    parts.append(at)
                    lengths.append(np.diff(first))
        if shard is not None:
            yield done()

    fitted = dealt.mapInArrow(fit, "shard int, at long, w double").toArrow().sort_by([("shard", "ascending"), ("at", "ascending")])
    at, w = fitted["at"].to_numpy(), fitted["w"].to_numpy()
    total = np.zeros((1 << bits) + 1)
    np.add.at(total, at, w)  # in the order of the shards; the bias is last, at -1
    trained = max(1, int((at < 0).sum()))
    kept = np.flatnonzero(total[:-1])
    return Model(kept, (total[kept] / trained).astype(np.float32), float(total[-1] / trained), bits, len(at) > 0)


def marks(labels: DataFrame, label_col: str = "toxic") -> DataFrame:
    return labels.select("doc_id", F.col(label_col).alias("label"))


def fold(id_col: str, parts: int):
    """crc32 of the id as text, modulo `parts`; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document doc_id, held_out, score, predicted; learned only from rows outside the held-out fold."""
    seen = labels.where(fold("doc_id", 5) != 0)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, marks(seen)))

    def run(batches):
        for batch in batches:
            score = model.value.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is under `threshold`, with all their columns."""
    trained = train(docs, marks(labels))
    if not trained.trained:
        return docs
    model = docs.sparkSession.sparkContext.broadcast(trained)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.value.scores(batch.column(at)) < threshold))

    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
