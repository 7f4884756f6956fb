"""Scoring texts with a model that is too large for one machine: its table stays sharded and is joined by key.

A text needs the values of thousands of keys (hashes of its n-grams), and texts share most of them. So texts
are taken in slices of at most about SLICE bytes (a longer text is a slice of its own):

1. each slice becomes one row: its rows as a compressed Arrow batch, and the distinct keys they ask for;
2. the keys are shuffled and joined with the model's table, both dealt by key;
3. what was found goes back to its slice, where the rows are scored with it.

A key that every text holds is asked for once a slice, so no key gathers a row for each text. Nothing is
broadcast or sent to the driver; memory follows the slice, and the traffic grows in proportion to the input
whatever the size of the model. A slice's number comes from its task and place, so a task that runs again
gives the same slices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K

SLICE = 1 << 24
_SCHEMA = "slice long, keys binary, rows binary"


def gathered(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of batches, whose last column is text, in batches of about `size` bytes of text."""
    held, have = [], 0
    for batch in batches:
        _, offsets = K.text_buffers(batch.column(batch.num_columns - 1))
        for a, b in K.slices(offsets, size):
            more = int(offsets[b] - offsets[a])
            if held and have + more > size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, have = [], 0
            held.append(batch.slice(a, b - a))
            have += more
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _packed(keys_of):
    def run(batches):
        part = TaskContext.get().partitionId() << 32
        for n, rows in enumerate(gathered(batches)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(rows)
            keys = np.unique(keys_of(rows.column(rows.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([pa.array([part + n]), pa.array([keys.tobytes()], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["slice", "keys", "rows"])

    return run


def _asked(batches):
    for batch in batches:
        for at, keys in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            values = np.frombuffer(keys.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.full(len(values), at))], ["key", "slice"])


def _answered(score, n_values):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = pa.ipc.open_stream(batch.column(2)[i].as_buffer()).read_all().combine_chunks().to_batches()[0]
                found = batch.column(3).slice(i, 1).flatten()
                if len(found):
                    key, *values = (c.to_numpy(zero_copy_only=False) for c in found.flatten())
                else:
                    key, values = np.empty(0, np.int64), [np.empty(0)] * n_values
                order = np.argsort(key.view(np.uint64))
                yield score(rows, key.view(np.uint64)[order], [v[order] for v in values])

    return run


def scored(rows: DataFrame, model: DataFrame, keys_of: Callable, score: Callable, schema: str) -> DataFrame:
    """`score(rows, keys, values)` of every slice of `rows`, whose last column is the text.

    `keys_of(texts)` gives the keys (uint64) that a text column asks for; `model` has a column key (long) and the
    values; `score` gets those found, sorted by key, and returns a record batch of `schema`.
    """
    packed = rows.mapInArrow(_packed(keys_of), _SCHEMA).repartition("slice")
    asked = packed.mapInArrow(_asked, "key long, slice long")
    values = [c for c in model.columns if c != "key"]
    found = asked.join(model, "key").groupBy(F.col("slice").alias("its_slice")).agg(F.collect_list(F.struct("key", *values)).alias("found"))
    both = packed.join(found, F.col("slice") == F.col("its_slice"), "left").select("slice", "keys", "rows", "found")
    return both.mapInArrow(_answered(score, len(values)), schema)


def place(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each wanted key among the sorted known ones, and whether it is there."""
    if not len(known):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted
