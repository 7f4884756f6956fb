"""Language identification in two steps: family first, then the languages within it.

Letters of the text, lower-cased and split at everything else, give byte n-grams of 1 to 4 bytes with word
edges, hashed into 2**bits coordinates and divided by their number. Linear support vector machines, one for
each pair of families and one for each pair of languages of a family, vote: the family with the largest
sum of squashed margins wins, and only its own languages are told apart, again by one-versus-one votes.
The score is the mean pairwise confidence of the family times that of the language.

Training takes at most `per_language` documents of each of the `max_languages` most frequent languages (those
with the smallest hashed ids: documented bounds, the same rows on every run); a machine between families takes
that many of each family. Texts become features where they are read, at most 2**bits numbers each, and only
those are shuffled. Each pair's machine is fitted by stochastic subgradient steps in a task of its own. The
weights, 2**bits for each pair, are all that reaches the driver. Prediction is one pass over whole texts without
a shuffle.

Defined cases: a null text, or one without a letter, is `und` with score 0; a text of any length is read whole. An
empty table gives an empty result. Rows with a null language or id are not learned from. Without any training row every document is `und`. A language of no listed family is a
family of its own; with one family, or one language in it, that step is certain. Repeated rows are scored
alike. Extra columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K

#: ISO 639-1 codes by language family.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "an ca co es fr gl it la oc pt ro sc wa",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "uralic": "et fi hu se",
    "turkic": "az ba kk ky tk tr tt ug uz",
    "indo-aryan": "as bn gu hi mr ne or pa sa sd si ur",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt ti",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv kw",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
UNKNOWN = "und"
NGRAMS = (1, 2, 3, 4)
#: Lower-cased letters stay, bytes of non-ASCII characters stay, the rest is an edge.
_LETTER = np.full(256, 32, np.uint8)
_LETTER[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]
_LETTER[65:91] = range(97, 123)


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0].split("_")[0], f"only {lang}")


def coordinates(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each text in order of n, and their documents."""
    clean = _LETTER[data]
    edge = clean == 32
    twice = np.zeros(len(clean), bool)
    twice[1:] = edge[1:] & edge[:-1]
    keep = ~twice
    kept = np.concatenate([[0], np.cumsum(keep)])
    clean, first = clean[keep], kept[offsets]
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(clean))
    value = np.zeros(len(clean), np.uint32)
    out, docs = [], []
    for n in NGRAMS:
        m = len(clean) - n + 1
        if m <= 0:
            break
        value[:m] |= clean[n - 1 : n - 1 + m].astype(np.uint32) << np.uint32(8 * (n - 1))
        inside = left[:m] >= n
        h = (value[:m][inside] + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
        h = (h ^ (h >> 15)) * np.uint32(0x85EBCA77)
        out.append(h >> np.uint32(32 - bits))
        docs.append(owner[:m][inside])
    if not out:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(docs)


def _featured(bits: int):
    """(o, lang, rank, text) -> the same with the text's coordinates and their shares * SCALE, packed."""

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in K.text_slices(batch.column(3)):
                at, owner = coordinates(data, offsets, bits)
                key, n = np.unique((owner.astype(np.int64) << bits) | at, return_counts=True)
                first = np.searchsorted(key, np.arange(b - a + 1, dtype=np.int64) << bits)
                cells, shares = [], []
                for i in range(b - a):
                    c = n[first[i] : first[i + 1]]
                    cells.append((key[first[i] : first[i + 1]] & ((1 << bits) - 1)).astype(np.uint16 if bits <= 16 else np.uint32).tobytes())
                    shares.append((c * (SCALE / max(1, c.sum()))).astype(np.float32).tobytes())
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(cells, pa.binary()), pa.array(shares, pa.binary())], ["o", "lang", "rank", "cells", "shares"])

    return run


SCALE = 20.0


def svm(vectors, y: np.ndarray, bits: int, passes: int = 8, rate: float = 0.5, decay: float = 1e-4, seed: int = 3) -> tuple[np.ndarray, float]:
    """Averaged subgradient steps on the hinge loss, both classes weighing the same."""
    w, total, b, b_total, t, scale = np.zeros(1 << bits), np.zeros(1 << bits), 0.0, 0.0, 0, 1.0
    weight = {c: len(y) / (2 * max(1, (y == c).sum())) for c in (-1, 1)}
    order = np.random.Generator(np.random.PCG64(seed))
    for _ in range(passes):
        for i in order.permutation(len(y)):
            t += 1
            step = rate / (1 + t * rate * 1e-3)
            at, x = vectors[i]
            scale *= 1 - step * decay
            if y[i] * (scale * (w[at] @ x) + b) < 1:
                g = step * weight[int(y[i])] * y[i]
                w[at] += g * x / scale
                b += 0.1 * g
                total[at] += t * g * x / scale  # lazily averaged: subtracted from t * w at the end
                b_total += t * 0.1 * g
    t = max(1, t)
    return scale * (w - total / (t + 1)), b - b_total / (t + 1)


def train(labelled: DataFrame, bits: int = 16, per_language: int = 1500, max_languages: int = 200) -> dict:
    """The languages, their families and pairwise weights, from rows (doc_id, text, lang)."""
    usable = labelled.where("lang IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text", "lang", F.xxhash64(F.col("doc_id").cast("string"), F.lit(11)).alias("o"))
    counts = [(r["lang"], r["n"]) for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()]
    langs = sorted(lang for lang, _ in counts)
    families = sorted({family(x) for x in langs})
    pairs = [("family", a, b) for a, b in combinations(families, 2)]
    pairs += [("language", a, b) for a, b in combinations(langs, 2) if family(a) == family(b)]
    model = {"langs": langs, "families": families, "pairs": pairs, "bits": bits, "w": np.zeros((1 << bits, len(pairs)), np.float32), "b": np.zeros(len(pairs))}
    if not pairs:
        return model
    # at least the hash below which a language has about per_language rows, then exactly that many of them
    share = {lang: min(1.0, 1.3 * (per_language + 50) / n) for lang, n in counts}
    edge = F.create_map(*[F.lit(x) for lang, p in share.items() for x in (lang, min(2**63 - 1, int((p * 2 - 1) * 2**63)))])
    near = usable.where(F.col("o") <= edge[F.col("lang")])
    first = Window.partitionBy("lang").orderBy("o", "doc_id", F.xxhash64("text"))
    sample = near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= per_language).select("o", "lang", "rank", "text")
    size = {lang: sum(family(x) == family(lang) for x in langs) for lang in langs}
    roles = {
        lang: [
            (i, 1 if lang == a or family(lang) == a and kind == "family" else -1, per_language if kind == "language" else -(-per_language // size[lang]))
            for i, (kind, a, b) in enumerate(pairs)
            if kind == "language" and lang in (a, b) or kind == "family" and family(lang) in (a, b)
        ]
        for lang in langs
    }
    role = F.create_map(*[x for lang, r in roles.items() for x in (F.lit(lang), F.array(*[F.struct(F.lit(i).alias("pair"), F.lit(y).alias("y"), F.lit(most).alias("most")) for i, y, most in r]))])
    featured = sample.mapInArrow(_featured(bits), "o long, lang string, rank int, cells binary, shares binary")
    dealt = featured.select("o", "rank", "cells", "shares", F.explode(role[F.col("lang")]).alias("r")).where("rank <= r.most").select("o", "rank", "cells", "shares", "r.pair", "r.y")

    def fit(key, rows):
        rows = rows.sort_by([("o", "ascending"), ("rank", "ascending"), ("y", "ascending")])
        kind = np.uint16 if bits <= 16 else np.uint32
        vectors = [(np.frombuffer(c, kind).astype(np.int64), np.frombuffer(x, np.float32).astype(np.float64)) for c, x in zip(rows["cells"].to_pylist(), rows["shares"].to_pylist(), strict=True)]
        w, b = svm(vectors, rows["y"].to_numpy(), bits)
        return pa.table({"pair": pa.array([key[0].as_py()], pa.int32()), "w": pa.array([w.astype(np.float32).tobytes()], pa.binary()), "b": [float(b)]})

    for r in dealt.groupBy("pair").applyInArrow(fit, "pair int, w binary, b double").collect():
        model["w"][:, r.pair], model["b"][r.pair] = np.frombuffer(r.w, np.float32), r.b
    return model


def _votes(margin: np.ndarray, pairs: list[tuple[int, int, int]], names: int) -> tuple[np.ndarray, np.ndarray]:
    """Winner and its mean pairwise confidence, from (column, first, second) of each machine."""
    if names == 1:
        return np.zeros(len(margin), int), np.ones(len(margin))
    total = np.zeros((len(margin), names))
    for column, a, b in pairs:
        p = 1 / (1 + np.exp(-np.clip(2 * margin[:, column], -30, 30)))
        total[:, a] += p
        total[:, b] += 1 - p
    best = total.argmax(axis=1)
    return best, total[np.arange(len(total)), best] / (names - 1)


def predict(model: dict, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Language index and score of each text."""
    langs, families, pairs = model["langs"], model["families"], model["pairs"]
    margins = []
    for a, b, data, offsets in K.text_slices(texts, 1 << 18):
        at, owner = coordinates(data, offsets, model["bits"])
        n = np.maximum(1, np.bincount(owner, minlength=b - a))
        m = np.empty((b - a, len(pairs)))
        for j in range(len(pairs)):
            m[:, j] = np.bincount(owner, weights=model["w"][:, j][at], minlength=b - a) * SCALE / n + model["b"][j]
        margins.append(m)
    margin = np.concatenate(margins) if margins else np.zeros((0, len(pairs)))
    top, sure = _votes(margin, [(i, families.index(a), families.index(b)) for i, (k, a, b) in enumerate(pairs) if k == "family"], len(families))
    lang, score = np.zeros(len(margin), int), np.zeros(len(margin))
    for f, name in enumerate(families):
        rows = np.flatnonzero(top == f)
        own = [x for x in langs if family(x) == name]
        best, p = _votes(margin[rows], [(i, own.index(a), own.index(b)) for i, (k, a, b) in enumerate(pairs) if k == "language" and a in own], len(own))
        lang[rows] = np.array([langs.index(x) for x in own])[best]
        score[rows] = p * sure[rows]
    return lang, score


def identify(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """Per document doc_id, lang_pred, score, with machines trained on (doc_id, text, lang)."""
    model = train(labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if not model["langs"]:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            names = np.array([*shared.value["langs"], UNKNOWN], object)
            lang, score = predict(shared.value, batch.column(1))
            known = batch.column(2).to_numpy(zero_copy_only=False)
            pred = names[np.where(known, lang, len(names) - 1)] if len(lang) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(np.where(known, score, 0.0))], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_predictions(docs: DataFrame, parts: int = 3, held: int = 1) -> DataFrame:
    """Per document doc_id, held_out, lang_pred, score; learned only from rows outside the held-out fold."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts
    out = identify(docs, docs.where(fold != held).select("doc_id", "text", "lang"))
    return out.select("doc_id", (fold == held).alias("held_out"), "lang_pred", "score")
