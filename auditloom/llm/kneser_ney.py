"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

The model predicts characters from up to ORDER - 1 characters before them; a text is padded at its start
and closed by an end mark. It is trained on every trusted document but the tenth that calibrates the threshold.
Counting pre-aggregates within each task; from the summed ORDER-grams the lower orders (continuation counts),
the discounts of each order, the totals of each context and the interpolated probabilities follow by grouped
sums and joins on the n-gram and its context, which Spark shards by hash.

A document's perplexity is exp of the negative mean log-probability of its characters and end mark. In
back-off form its log-probability is a sum over positions: the probability of the longest known n-gram and
the back-off weights of the longer contexts. The model is never gathered: the distinct n-grams of each slice of
documents are joined with the sharded table (see `lookup`), and what is found scores the slice's documents.

A document is kept if its perplexity is at most its language's threshold, a quantile of the perplexities of
that language's held-out trusted documents (of all held-out ones for a language without any; of all trusted
ones if none is held out). A tenth of the trusted documents, by hashed id, is held out: the model has not seen
them, so their perplexities are those of new clean text.

Defined cases: a null or empty text has no perplexity and is not kept. A text of any length is scored whole.
Null languages form a language of their own; rows with a null id are never trusted. Without trusted text there
is no model: perplexity and threshold are null and every text that is not empty is kept, for lack of evidence.
A trusted id that several rows carry counts each row. Extra columns are not read. An empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from . import lookup
from .shared import cut_lineage, small_or_shuffled

ORDER = 4
PAD, END = "\x02", "\x03"
#: Code points counted as the size of the alphabet that unseen characters share.
ALPHABET = 1 << 16


def _padded(texts: pa.Array):
    """Bytes, character starts (with the end), and each text's first character, of padded non-empty texts."""
    raw = [PAD * (ORDER - 1) + t + END if t else "" for t in texts.to_pylist()]
    data = np.frombuffer("".join(raw).encode(), np.uint8)
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    return data, np.append(starts, len(data)), first


def _predicted(first: np.ndarray) -> np.ndarray:
    """The characters that are predicted: all but the padding."""
    n = np.diff(first)
    depth = np.arange(first[-1]) - np.repeat(first[:-1], n)
    return np.flatnonzero(depth >= ORDER - 1)


def _batches(texts: pa.Array, size: int = 1 << 20):
    _, offsets = K.text_buffers(texts)
    for a, b in K.slices(offsets, size):
        yield a, b, texts.slice(a, b - a)


def count_grams(batches):
    """(text) -> (gram, n): the task's distinct ORDER-grams; merged whenever a few million have piled up."""
    held: list[pa.Table] = []
    rows = 0

    def merged():
        table = pa.concat_tables(held).group_by("gram").aggregate([("n", "sum")])
        return pa.table({"gram": table["gram"], "n": table["n_sum"]})

    for batch in batches:
        for _, _, texts in _batches(batch.column(0)):
            data, starts, first = _padded(texts)
            at = _predicted(first)
            if not len(at):
                continue
            prefix = K.prefix_hash(data)
            begin, end = starts[at - ORDER + 1], starts[at + 1]
            _, where, n = np.unique(K.span_hash(prefix, begin, end), return_index=True, return_counts=True)
            begin, size = begin[where], end[where] - begin[where]
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            flat = np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])
            gram = pa.Array.from_buffers(pa.string(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[flat]))])
            held.append(pa.table({"gram": gram, "n": n}))
            rows += len(n)
            if rows > 3_000_000:
                held = [merged()]
                rows = held[0].num_rows
                if rows > 1_500_000:
                    yield from held[0].to_batches()
                    held, rows = [], 0
    if held:
        yield from merged().combine_chunks().to_batches()


def _discounts(table: DataFrame) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of n-grams seen once to four times."""
    n = {r.c: r.k for r in table.where("c <= 4").groupBy("c").agg(F.count("*").alias("k")).collect()}
    n1, n2, n3, n4 = (float(n.get(i, 0)) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    ratio = [(n2, n1), (n3, n2), (n4, n3)]
    return tuple(min(i + 1.0, max(0.0, i + 1 - (i + 2) * y * (a / b))) if b else 0.5 for i, (a, b) in enumerate(ratio))


def train(texts: DataFrame) -> DataFrame:
    """(key, log_p, log_b) from rows (text): for the hash of each n-gram its log-probability as an n-gram and,
    where it is a context, its back-off weight; 0 where it is not one of them."""
    counted = texts.select("text").mapInArrow(count_grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("c"))
    top = cut_lineage(counted)
    levels = {ORDER: top}
    for k in range(ORDER - 1, 0, -1):
        shorter = levels[k + 1].select(F.substring("gram", 2, k).alias("gram"))
        levels[k] = cut_lineage(shorter.groupBy("gram").agg(F.count("*").alias("c")))
    lower, out = None, []
    for k in range(1, ORDER + 1):
        d = _discounts(levels[k])
        cut = F.least(F.col("c"), F.lit(3))
        off = F.element_at(F.array(*map(F.lit, d)), cut.cast("int"))
        level = levels[k].withColumns({"context": F.substring("gram", 1, k - 1), "suffix": F.substring("gram", 2, k - 1), "off": off})
        contexts = cut_lineage(level.groupBy("context").agg(F.sum("c").alias("total"), F.sum("off").alias("left")))
        level = level.join(contexts, "context")
        if lower is None:
            level = level.withColumn("lower", F.lit(1.0 / ALPHABET))
        else:
            level = level.join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("lower")), "suffix")
        p = F.greatest(F.col("c") - F.col("off"), F.lit(0.0)) / F.col("total") + F.col("left") / F.col("total") * F.col("lower")
        level = cut_lineage(level.select("gram", p.alias("p")))
        out += [level.select("gram", F.log("p").alias("log_p"), F.lit(0.0).alias("log_b")), contexts.select(F.col("context").alias("gram"), F.lit(0.0).alias("log_p"), F.log(F.col("left") / F.col("total")).alias("log_b"))]
        lower = level
    both = out[0]
    for more in out[1:]:
        both = both.unionByName(more)
    return both.groupBy("gram").agg(F.sum("log_p").alias("log_p"), F.sum("log_b").alias("log_b"))


def hash_grams(grams: pa.Array) -> np.ndarray:
    """The keys under which the scoring finds n-grams; that of the empty context is 0's mixed value."""
    data, offsets = K.text_buffers(grams)
    out = np.zeros(len(grams), np.uint64)
    for a, b in K.slices(offsets):
        part = data[offsets[a] : offsets[b]]
        o = offsets[a : b + 1] - offsets[a]
        out[a:b] = K.span_hash(K.prefix_hash(part), o[:-1], o[1:])
    return out


def _by_key(model: DataFrame) -> DataFrame:
    """(key, log_p, log_b) of a model's rows (gram, log_p, log_b)."""

    def run(batches):
        for batch in batches:
            key = K.signed(hash_grams(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(key), *(batch.column(i).cast(pa.float32()) for i in (1, 2))], ["key", "log_p", "log_b"])

    return model.select("gram", "log_p", "log_b").mapInArrow(run, "key long, log_p float, log_b float")


class _Positions:
    """The predicted places of a batch of texts, their distinct ORDER-grams, and hashes of parts of those."""

    def __init__(self, texts: pa.Array):
        self.data, self.starts, self.first = _padded(texts)
        self.at = _predicted(self.first)
        self.prefix = K.prefix_hash(self.data)
        gram = K.span_hash(self.prefix, self.starts[self.at - ORDER + 1], self.starts[self.at + 1]) if len(self.at) else np.empty(0, np.uint64)
        _, where, self.which = np.unique(gram, return_index=True, return_inverse=True)
        self.distinct = self.at[where]

    def grams(self, k: int) -> np.ndarray:
        return K.span_hash(self.prefix, self.starts[self.distinct - k + 1], self.starts[self.distinct + 1])

    def contexts(self, k: int) -> np.ndarray:
        return K.span_hash(self.prefix, self.starts[self.distinct - k + 1], self.starts[self.distinct])


def _wanted(texts: pa.Array) -> np.ndarray:
    """Keys of all n-grams, and contexts of n-grams, that predict a character of the texts."""
    out = [np.empty(0, np.uint64)]
    for _, _, part in _batches(texts):
        here = _Positions(part)
        out.append(np.unique(np.concatenate([f(k) for k in range(1, ORDER + 1) for f in (here.grams, here.contexts)])))
    return np.concatenate(out)


def log_probability(keys: np.ndarray, log_p: np.ndarray, log_b: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sum of log-probabilities and number of predictions of each text, with the model's values of sorted keys."""
    here = _Positions(texts)
    total = np.zeros(len(here.distinct))
    open_ = np.ones(len(total), bool)
    for k in range(ORDER, 0, -1):
        at, known = lookup.place(keys, here.grams(k))
        known &= open_
        known[known] = log_p[at[known]] < 0
        total[known] += log_p[at[known]]
        open_ &= ~known
        at, known = lookup.place(keys, here.contexts(k))
        known &= open_
        total[known] += log_b[at[known]]
    total[open_] -= np.log(ALPHABET)
    edge = np.searchsorted(here.at, here.first)
    return K.sums(total[here.which], edge), np.diff(edge)


def _score(rows: pa.RecordBatch, keys: np.ndarray, values: list[np.ndarray]) -> pa.RecordBatch:
    parts = [log_probability(keys, *values, texts) for _, _, texts in _batches(rows.column(3))]
    total, n = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0), np.empty(0))
    ppl = pa.array(np.exp(-total / np.maximum(n, 1)), pa.float64(), mask=n == 0)
    return pa.RecordBatch.from_arrays([*rows.columns[:3], ppl], ["doc_id", "lang", "some", "perplexity"])


def perplexities(docs: DataFrame, trusted_text: DataFrame) -> DataFrame:
    """(doc_id, lang, some, perplexity) of docs (doc_id, lang, text), with a model of the texts of `trusted_text`.

    `some` says that the text is not empty."""
    model = cut_lineage(_by_key(train(trusted_text.where("text IS NOT NULL AND text <> ''"))))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text") != "", F.lit(False)).alias("some"), "text")
    if model.limit(1).count() == 0:
        return docs.select("doc_id", "lang", "some", F.lit(None).cast("double").alias("perplexity"))
    return lookup.scored(docs, model, _wanted, _score, "doc_id long, lang string, some boolean, perplexity double")


def quality(docs: DataFrame, labels: DataFrame, quantile: float = 0.99) -> DataFrame:
    """Per document doc_id, lang, perplexity, threshold, keep; trusted are the documents labelled quality 1."""
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    held = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(13)), F.lit(10)) == 0
    trusted = small_or_shuffled(trusted)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(~held).join(trusted, "doc_id", "left_semi")
    scored = cut_lineage(perplexities(docs, texts))
    good = scored.join(trusted, "doc_id", "left_semi").withColumn("held", held)
    new = F.when(F.col("held"), F.col("perplexity"))
    at = lambda value: F.percentile_approx(value, F.lit(quantile), F.lit(10_000))
    by_lang = good.groupBy(F.col("lang").alias("t_lang")).agg(at(new).alias("own"))
    overall = good.agg(F.coalesce(at(new), at(F.col("perplexity"))).alias("overall"))
    out = scored.join(F.broadcast(overall)).join(small_or_shuffled(by_lang), F.col("lang").eqNullSafe(F.col("t_lang")), "left")
    threshold = F.coalesce("own", "overall")
    keep = F.col("some") & F.coalesce(F.col("perplexity") <= threshold, F.lit(True))
    return out.select("doc_id", "lang", "perplexity", threshold.alias("threshold"), keep.alias("keep"))
