"""Vector code compression: product quantisation in fixed point, with exact nearest entries.

Components become integers, floor(256 * x). A vector is cut into equal parts; each part position has a codebook,
which starts as that part of the first vectors and moves to the floor of its members' means in each round. A
vector's code is the index of the nearest entry for each part.

Nearest entries are found in two steps. A float32 matrix product gives all products of parts with entries; each is off
by at most gamma = (w + 2) u / (1 - (w + 2) u) times the product of the norms (w the width of a part, u = 2**-24: two
roundings of the operands, w of the sum, in whatever order the product adds). So |c|**2 - 2 x.c lies in a known
interval for every entry, and only entries whose interval reaches down to the least upper end can be nearest. These are
evaluated in int64, and ties go to the lower index. The result is that of integer arithmetic throughout.

Vectors are never shuffled: each round reads them where they are, adds up its members in the task, and sends one row
for each (part, entry, position) used. Codebooks have `entries` rows of the vectors' width: a fixed size, held by the
driver and broadcast. Errors of a label are partial sums joined back without a hot key.

Defined cases: a vector that is null, empty or holds a null or non-finite component is dropped. So is one with a
component of 2**18 or more, whose squared distances would leave int64, and one of another length than the first kept
vector (in order of id), which cannot be cut alike. That length must be a multiple of the number of parts, else a
ValueError says so. Null ids come last in the order; rows that repeat an id are ordered by their components. Fewer
kept vectors than entries make smaller codebooks. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut_lineage, join_hot

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components from here on are not representable: twice 2**26, squared, times a width of up to 2**9 stays below 2**63.
LIMIT = float(1 << 18)
_ROWS = 4096
_UNIT = 2.0**-24


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values (float64, NaN for null), first place and length of each list; a null list has length 0."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    values = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    return values, np.cumsum(size) - size, size


def whole_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows whose vector is kept, and the values, first places and lengths of all."""
    values, first, size = _lists(column)
    with np.errstate(invalid="ignore"):
        bad = ~(np.abs(values) < LIMIT)
    total = np.concatenate([[0], np.cumsum(bad)])
    return np.flatnonzero((size > 0) & (total[first + size] == total[first])), values, first, size


def matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector is kept and has `dims` components, and these as integers."""
    rows, values, first, size = whole_vectors(column)
    rows = rows[size[rows] == dims]
    return rows, np.floor(values[first[rows][:, None] + np.arange(dims)] * SCALE).astype(np.int64)


class Books:
    """Codebooks (parts, entries, width) of integers, with what screening needs of them."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.single = values.astype(np.float32)
        self.squares = (values * values).sum(2).astype(np.float64)
        self.norms = np.sqrt(self.squares) * (1 + 1e-12)

    def nearest(self, x: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and the squared distance, of each row of one part's integers."""
        n, width = x.shape
        off = (width + 2) * _UNIT / (1 - (width + 2) * _UNIT)
        product = (x.astype(np.float32) @ self.single[part].T).astype(np.float64)
        score = self.squares[part] - 2 * product
        norm = np.sqrt((x * x).sum(1).astype(np.float64)) * (1 + 1e-12)
        radius = 2 * off * norm[:, None] * self.norms[part] * (1 + 1e-9)
        radius += (self.squares[part] + 2 * np.abs(product)) * 2.0**-50
        least = (score + radius).min(1)
        row, entry = np.nonzero(score - radius <= least[:, None])
        gap = x[row] - self.values[part][entry]
        distance = (gap * gap).sum(1)
        best = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(best, row, distance)
        won = distance == best[row]
        index = np.full(n, len(self.values[part]), np.int64)
        np.minimum.at(index, row[won], entry[won])
        return index, best


def _blocks(column: pa.Array, dims: int):
    """(rows, integers cut into parts) of slices of a batch."""
    for at in range(0, len(column), _ROWS):
        rows, x = matrix(column.slice(at, _ROWS), dims)
        yield rows + at, x


def first_vectors(vectors: DataFrame, id_col: str, vector_col: str, entries: int) -> np.ndarray:
    """The kept vectors with the smallest ids as integers; their length is that of the first."""

    def run(batches):
        held = None
        for batch in batches:
            rows, _, _, size = whole_vectors(batch.column(1))
            mine = pa.Table.from_batches([batch.take(pa.array(rows))]).append_column("size", pa.array(size[rows], pa.int64()))
            held = mine if held is None else pa.concat_tables([held, mine])
            keep = []
            for n in np.unique(held["size"].to_numpy()).tolist():
                at = np.flatnonzero(held["size"].to_numpy() == n)
                ids = held["vec_id"].take(pa.array(at)).to_pylist()
                order = sorted(range(len(at)), key=lambda i: (ids[i] is None, ids[i] or 0))
                last = ids[order[min(entries, len(order)) - 1]]
                tied = [i for i in order if ids[i] == last]
                before = order.index(tied[0])
                keep += at[order[:before]].tolist()
                # rows that share the last id are told apart by their components
                tied.sort(key=lambda i: held["embedding"][int(at[i])].as_py())
                keep += at[tied[: entries - before]].tolist()
            held = held.take(pa.array(keep, pa.int64()))
        if held is not None:
            yield from held.combine_chunks().to_batches()

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    order = (F.col("vec_id").asc_nulls_last(), F.col("embedding").asc())
    found = cut_lineage(rows.mapInArrow(run, "vec_id long, embedding array<double>, size long"))
    one = found.orderBy(*order).select("size").first()
    if one is None:
        return np.zeros((0, 0), np.int64)
    chosen = found.where(F.col("size") == one["size"]).orderBy(*order).limit(entries).collect()
    return np.floor(np.array([r.embedding for r in chosen]) * SCALE).astype(np.int64)


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each used entry is the floor of its members' mean."""
    parts, entries, width = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        mine = Books(shared.value)
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for _, x in _blocks(batch.column(0), parts * width):
                for p in range(parts):
                    cut = x[:, p * width : (p + 1) * width]
                    index, _ = mine.nearest(cut, p)
                    order = np.argsort(index, kind="stable")
                    used, start, n = np.unique(index[order], return_index=True, return_counts=True)
                    if len(used):
                        total[p, used] += np.add.reduceat(cut[order], start, axis=0)
                        count[p, used] += n
        part, entry = np.nonzero(count)
        place = np.arange(len(part) * width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(part, width)), pa.array(np.repeat(entry, width)), pa.array(place % width), pa.array(total[part, entry].ravel()), pa.array(np.repeat(count[part, entry], width))],
            ["part", "entry", "place", "total", "n"],
        )

    sums = rows.select("embedding").mapInArrow(run, "part long, entry long, place long, total long, n long")
    exact = sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    out = books.copy()
    for r in exact:
        out[r.part, r.entry, r.place] = int(r.total) // r.n
    shared.unpersist()
    return out


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding") -> np.ndarray | None:
    """Codebooks (parts, entries, width) of a table of vectors, None where it has no vector."""
    start = first_vectors(vectors, id_col, vector_col, entries)
    if not start.size:
        return None
    if start.shape[1] % parts:
        raise ValueError(f"vectors of {start.shape[1]} components cannot be cut into {parts} equal parts")
    books = np.ascontiguousarray(start.reshape(len(start), parts, -1).transpose(1, 0, 2))
    rows = vectors.select(F.col(vector_col).cast("array<double>").alias("embedding"))
    for _ in range(rounds):
        books = moved(rows, books)
    return books


def encode(vectors: DataFrame, books: np.ndarray, vector_col: str = "embedding") -> DataFrame:
    """The kept rows with all their columns, their `code` (two hex digits a part, more beyond 256 entries) and `error`."""
    names, at = vectors.columns, vectors.columns.index(vector_col)
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    parts, entries, width = books.shape
    digits = max(2, len(f"{entries - 1:x}"))
    plain = vectors.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches):
        mine = Books(shared.value)
        written = np.array([f"{i:0{digits}x}" for i in range(entries)])
        for batch in batches:
            for rows, x in _blocks(batch.column(at), parts * width):
                error, code = np.zeros(len(rows), np.int64), np.full(len(rows), "", f"<U{digits * parts}")
                for p in range(parts):
                    index, distance = mine.nearest(x[:, p * width : (p + 1) * width], p)
                    error += distance
                    code = np.char.add(code, written[index])
                kept = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(code.tolist(), pa.string()), pa.array(error)], [*kept.schema.names, "code", "error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.mapInArrow(run, f"{fields}, code string, error long").toDF(*names, "code", "error")


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def decoded(code: str, books: np.ndarray) -> np.ndarray:
    """The vector that a code stands for: each component in the middle of its step."""
    parts = len(books)
    digits = len(code) // parts
    return (np.concatenate([books[p, int(code[p * digits : (p + 1) * digits], 16)] for p in range(parts)]) + 0.5) / SCALE


def vector_codes(vectors: DataFrame) -> DataFrame:
    """Per kept vector its code, its error, the error of its label, and the digest of the codebooks."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    books = train(rows)
    if books is None:
        return rows.where("false").select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))])
    coded = cut_lineage(encode(rows, books).select("vec_id", "code", "error", F.coalesce(F.col("label").cast("string"), F.lit("-")).alias("of")))
    labels = cut_lineage(coded.groupBy("of").agg(F.sum("error").alias("label_error")))
    return join_hot(coded, labels, "of").select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
