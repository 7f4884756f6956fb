"""Document fingerprints: a quartile bucket digest.

Byte triplets from a sliding window of five bytes are hashed into buckets and counted. A bucket's code,
0 to 3, says between which quartiles of the document's bucket counts its count lies. The digest is the
logarithmic length and two bits a bucket, in hex: a fixed size for texts of any length. The difference of
two digests is the sum of the bucket codes' distances plus a capped length distance, so it is bounded, and
likeness is one minus its share of the bound.

`fingerprints` also compares each document with its successor in descending id order. The order is made
without a global window: ids are cut at quantiles into ranges, each range receives a copy of the first
document of the range after it, and every range is sorted and streamed with one document carried over. The
text is shuffled once.

Defined cases: a null text is empty; a text under three bytes has no triplets and all codes 0. A null id
comes last in the order. Rows that repeat an id are ordered by text. A single document is its own
successor. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K

BUCKETS = 256
#: Offsets of the triplets within a window of five bytes.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
LENGTH_STEPS, LENGTH_WEIGHT = 12, 4
BOUND = 3 * BUCKETS + LENGTH_STEPS * LENGTH_WEIGHT
FIRST = -(1 << 63)


def digests(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of 1 + BUCKETS small integers for each text: length code, then bucket codes."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    counts = np.zeros(n * BUCKETS, np.int64)
    owner = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, size)
    left = np.repeat(offsets[1:], size) - np.arange(len(data))
    wide = data.astype(np.uint32)
    for kind, (_, b, c) in enumerate(TRIPLETS):
        m = len(data) - c
        if m <= 0:
            continue
        h = wide[:m] | (wide[b : b + m] << 8) | (wide[c : c + m] << 16) | np.uint32(kind << 24)
        h = (h ^ (h >> 15)) * np.uint32(0x2C1B3C6D)
        h = (h ^ (h >> 12)) * np.uint32(0x297A2D39)
        inside = left[:m] > c
        counts += np.bincount(owner[:m][inside] + (h[inside] >> 24), minlength=n * BUCKETS)
    counts = counts.reshape(n, BUCKETS)
    ranked = np.sort(counts, axis=1)
    out = np.zeros((n, 1 + BUCKETS), np.uint8)
    for q in (1, 2, 3):
        out[:, 1:] += counts > ranked[:, [q * BUCKETS // 4 - 1]]
    out[:, 0] = np.minimum(255, np.log1p(size) / np.log(1.15))
    return out


def to_hex(codes: np.ndarray) -> list[str]:
    c = codes[:, 1:].reshape(len(codes), BUCKETS // 4, 4)
    packed = (c[..., 0] | (c[..., 1] << 2) | (c[..., 2] << 4) | (c[..., 3] << 6)).astype(np.uint8)
    return [bytes(row).hex() for row in np.concatenate([codes[:, :1], packed], axis=1)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests, 0 for the largest possible difference."""
    d = np.abs(a.astype(np.int16) - b.astype(np.int16))
    return 1 - (d[:, 1:].sum(axis=1) + np.minimum(d[:, 0], LENGTH_STEPS) * LENGTH_WEIGHT) / BOUND


def _digest_texts(texts: pa.Array) -> np.ndarray:
    out = [digests(data, offsets) for _, _, data, offsets in K.text_slices(texts)]
    return np.concatenate(out) if out else np.zeros((0, 1 + BUCKETS), np.uint8)


def digest_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every text, in one pass without a shuffle."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(to_hex(_digest_texts(batch.column(1))), pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def _placed(keyed: DataFrame) -> DataFrame:
    """Rows (part, guard, key, text): ranges of descending key, each ending with the next range's first document."""
    spark = keyed.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = keyed.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0]
    cuts = np.unique(np.array(cuts or [], np.int64))

    def part(key: np.ndarray) -> np.ndarray:
        return len(cuts) - np.searchsorted(cuts, key, "left")

    def heads(batches):
        for batch in batches:
            key = batch.column(0).to_numpy()
            order = np.argsort(key, kind="stable")[::-1]
            p = part(key[order])
            at, first = np.unique(p, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(key[order][first])], ["part", "key"])

    first = keyed.select("key").mapInArrow(heads, "part int, key long").groupBy("part").agg(F.max("key").alias("key")).collect()
    head = {r.part: r.key for r in first}
    parts = sorted(head)
    before = {p: parts[i - 1] for i, p in enumerate(parts)}  # parts[-1] precedes the first: the ring closes

    def place(batches):
        for batch in batches:
            key = batch.column(0).to_numpy()
            p = part(key)
            guard = np.flatnonzero([key[i] == head[x] for i, x in enumerate(p.tolist())]) if len(key) else np.zeros(0, np.int64)
            rows = pa.array(np.concatenate([np.arange(len(key)), guard]))
            at = np.concatenate([p, [before[x] for x in p[guard].tolist()]])
            flag = np.concatenate([np.zeros(len(key)), np.ones(len(guard))])
            both = batch.take(rows)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(flag, pa.int32()), both.column(0), both.column(1)], ["part", "guard", "key", "text"])

    return keyed.mapInArrow(place, "part int, guard int, key long, text string")


def edited_text(text: str, successor: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + successor[:half]


def _compare(batches):
    carried = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([carried, batch] if carried is not None else [batch]).combine_chunks().to_batches()[0]
        carried = rows.slice(rows.num_rows - 1)
        _, offsets = K.text_buffers(rows.column(3))
        guard = rows.column(1).to_numpy()
        own = _digest_texts(rows.column(3))
        for a, b in K.slices(offsets[:-1]):  # rows a to b and the row after them
            take = np.flatnonzero(guard[a:b] == 0) + a
            texts = rows.column(3).slice(a, b - a + 1).to_pylist()
            new = [edited_text(texts[i - a] or "", texts[i - a + 1] or "") for i in take]
            raw = [x.encode() for x in new]
            changed = _digest_texts(pa.array(raw, pa.large_binary())) if raw else own[:0]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(2).take(pa.array(take)),
                    pa.array([len(texts[i - a] or "") for i in take], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
                    pa.array(to_hex(own[take]), pa.string()),
                    pa.array(to_hex(changed), pa.string()),
                    pa.array(likeness(own[take], changed), pa.float64()),
                    pa.array(likeness(own[take], own[take + 1]), pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its fingerprint, that of its edited text, and its likeness to both neighbours."""
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = _placed(keyed).repartition("part").sortWithinPartitions("part", "guard", F.desc("key"), F.desc("text"))
    out = ordered.mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(FIRST)))
