"""URL filters: allow and block rules, then a ratio of character language models.

A rule (host, path) fits its host and all its subdomains if the url's path starts with the rule's; the
longest fitting rule decides. Urls that no rule fits are judged by two smoothed variable-order Markov
models over the characters of host and path, one learned from the urls that rules accept, one from those
they reject. Every character is predicted from contexts of 0 to `order` characters, each order smoothed by
the one below it (n + strength * lower) / (context + strength), so the longest context with evidence leads.
The score is the difference of the log-likelihoods divided by the length. The threshold is calibrated on a
tenth of the rule-labelled urls, which the models do not learn from.

Counts come from all rule-labelled urls, keyed by the full 64-bit hash of n-gram or context, and are summed in
Spark. The table grows with the urls and stays sharded: the distinct n-grams of each slice of urls are joined
with it, and what is found scores the slice (see `lookup`).

Defined cases: a null url, or one without `://`, has an empty host and path, fits no rule and is judged by
its empty text. If no url is accepted, or none rejected, by rule, the ratio tells nothing: the score is 0
and the verdict allow. Repeated rows count as often as they occur. A url of any length is scored whole. Extra
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from . import lookup
from .shared import cut_lineage

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, _URL, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(text, _URL, 2)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), null if none fits; of equal ones the first listed."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _grams(texts: pa.Array, order: int):
    """For each order the keys of (context, next character) and of the context at every position, and which
    positions have that long a context; and each text's first position. A NUL ends every text."""
    raw = [(x or "").encode() + b"\0" for x in texts.to_pylist()]
    data = np.frombuffer(b"".join(raw), np.uint8)
    first = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    prefix = K.prefix_hash(data)
    at = np.arange(len(data))
    depth = at - np.repeat(first[:-1], np.diff(first))
    out = []
    for k in range(order + 1):
        start = np.maximum(at - k, 0)
        salt = np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 % 2**63)
        gram = K.mix(K.span_hash(prefix, start, at + 1) ^ salt)
        context = K.mix(K.span_hash(prefix, start, at) ^ (salt + np.uint64(7)))
        out.append((gram, context, depth >= k))
    return out, first


def train(labelled: DataFrame, order: int = 5) -> DataFrame:
    """(key, accepted, rejected): how often n-grams and contexts occur in the urls (text, rejected) of each class."""

    def count(batches):
        for batch in batches:
            rejected = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b, _, _ in K.text_slices(batch.column(0)):
                levels, first = _grams(batch.column(0).slice(a, b - a), order)
                label = np.repeat(rejected[a:b], np.diff(first))
                keys = np.concatenate([part[whole] for gram, context, whole in levels for part in (gram, context)])
                labels = np.concatenate([label[whole] for _, _, whole in levels for _ in (0, 1)])
                key, which = np.unique(keys, return_inverse=True)
                n = np.bincount(which, minlength=len(key))
                bad = np.bincount(which, weights=labels, minlength=len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(key)), pa.array(n - bad), pa.array(bad)], ["key", "accepted", "rejected"])

    rows = labelled.select("text", F.col("rejected").cast("int").alias("rejected"))
    counted = rows.mapInArrow(count, "key long, accepted long, rejected long")
    return counted.groupBy("key").agg(F.sum("accepted").cast("double").alias("accepted"), F.sum("rejected").cast("double").alias("rejected"))


def _wanted(order: int):
    def keys_of(texts: pa.Array) -> np.ndarray:
        out = [np.empty(0, np.uint64)]
        for a, b, _, _ in K.text_slices(texts):
            levels, _ = _grams(texts.slice(a, b - a), order)
            out.append(np.unique(np.concatenate([part[whole] for gram, context, whole in levels for part in (gram, context)])))
        return np.concatenate(out)

    return keys_of


def score_texts(keys: np.ndarray, counts: list[np.ndarray], texts: pa.Array, order: int, strength: float) -> np.ndarray:
    """(log P(text | accepted) - log P(text | rejected)) / characters, from the counts of sorted keys."""
    out = []
    for a, b, _, _ in K.text_slices(texts):
        levels, first = _grams(texts.slice(a, b - a), order)
        places = [(lookup.place(keys, gram), lookup.place(keys, context), whole) for gram, context, whole in levels]
        logs = []
        for count in counts:
            p = np.full(first[-1], 1 / 256)
            seen = lambda at, known, count=count: np.where(known, count[at], 0.0) if len(count) else np.zeros(len(at))
            for gram, context, whole in places:
                deeper = (seen(*gram) + strength * p) / (seen(*context) + strength)
                p = np.where(whole, deeper, p)
            logs.append(np.log(p))
        out.append(K.sums(logs[0] - logs[1], first) / np.diff(first))
    return np.concatenate(out) if out else np.empty(0)


def with_scores(rows: DataFrame, model: DataFrame, order: int, strength: float) -> DataFrame:
    """The rows, whose last column is the text to score, with a score in its place."""
    fields = rows.schema.fields[:-1]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "score double"])

    def score(batch, keys, counts):
        last = batch.num_columns - 1
        points = score_texts(keys, counts, batch.column(last), order, strength)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(points)], [*batch.schema.names[:-1], "score"])

    return lookup.scored(rows, model, _wanted(order), score, schema)


def calibrate(scored: DataFrame) -> float:
    """The threshold with the best mean of both classes' accuracies, from a histogram of at most 2,001 scores.

    Of equally good thresholds the one nearest to 0, then the larger, is taken; 0 if a class is missing."""
    step = F.greatest(F.lit(-1000), F.least(F.lit(1000), F.floor(F.col("score") * 100))).cast("int")
    rows = scored.groupBy(step.alias("step")).agg(F.count_if(~F.col("rejected")).alias("a"), F.count_if("rejected").alias("r")).collect()
    a, r = np.zeros(2001), np.zeros(2001)
    for x in rows:
        a[x.step + 1000], r[x.step + 1000] = x.a, x.r
    if not a.sum() or not r.sum():
        return 0.0
    kept = np.append(a[::-1].cumsum()[::-1], 0) / a.sum()
    dropped = np.insert(r.cumsum(), 0, 0) / r.sum()
    good = np.round(kept + dropped, 9)
    best = np.flatnonzero(good == good.max()) - 1000
    return float(min(best, key=lambda i: (abs(i), -i))) / 100


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", order: int = 5, strength: float = 2.0) -> DataFrame:
    """Per page page_id, host, path, rule, verdict, score."""
    host, path = host_and_path(F.col("u"))
    parsed = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("u")).select("page_id", host.alias("host"), path.alias("path"))
    ruled = parsed.withColumn("hit", rule_for(F.col("host"), F.col("path"), rules))
    rows = ruled.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("ruling"), F.concat("host", "path").alias("lm_text"))
    held = F.pmod(F.xxhash64("lm_text"), F.lit(10)) == 0
    rejected = (F.col("ruling") == "block").alias("rejected")
    learned = rows.where("ruling IS NOT NULL").where(~held).select(F.col("lm_text").alias("text"), rejected)
    both = {r.rejected for r in learned.groupBy("rejected").count().collect()}
    if len(both) < 2:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("ruling", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    scored = with_scores(rows.select("page_id", "host", "path", "rule", "ruling", held.alias("held"), "lm_text"), cut_lineage(train(learned, order)), order, strength)
    scored = cut_lineage(scored)
    threshold = calibrate(scored.where("held AND ruling IS NOT NULL").select("score", rejected))
    verdict = F.coalesce("ruling", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
