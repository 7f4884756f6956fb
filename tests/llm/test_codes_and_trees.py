"""Vector codes and Merkle manifests against plain definitions."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditloom.llm import merkle, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, code string, of string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_codes(rows):
    """vec_id, code, error, label_error, digest by integer arithmetic over all entries."""
    whole = [(i, v, lb) for i, v, lb in rows if v and all(x is not None and abs(x) < 2**18 for x in v)]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [r for r in whole if len(r[1]) == len(whole[0][1])]
    if not whole:
        return []
    x = np.array([[int(np.floor(256 * np.float64(np.float32(c)))) for c in v] for _, v, _ in whole], np.int64).reshape(len(whole), 16, -1)
    books = x[:64].copy()

    def nearest():
        d = ((x[:, None] - books[None]) ** 2).sum(3)
        return d.argmin(1), d.min(1)

    for _ in range(2):
        index, _ = nearest()
        new = books.copy()
        for p in range(16):
            for e in range(len(books)):
                mine = x[index[:, p] == e, p]
                if len(mine):
                    new[e, p] = [int(s) // len(mine) for s in mine.sum(0)]
        books = new
    index, d = nearest()
    digest = sha(",".join(str(v) for p in range(16) for e in range(len(books)) for v in books[e, p]))
    by_label = defaultdict(int)
    for r, e in zip(whole, d.sum(1), strict=True):
        by_label[r[2]] += int(e)
    return [(r[0], "".join(f"{e:02x}" for e in i), int(e.sum()), by_label[r[2]], digest) for r, i, e in zip(whole, index, d, strict=True)]


def key(row):
    return tuple((v is None, str(v)) for v in row)


def same(df, want):
    got = [tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, lb, "c", "o") for i, v, lb in rows], VECTORS).repartition(parts)


@pytest.mark.parametrize(("count", "width", "step"), [(200, 32, 0.01), (90, 16, 0.5), (30, 48, 3.0)])
def test_vector_codes(spark, count, width, step):
    rnd = random.Random(count)
    rows = [(rnd.randrange(10 * count), [float(np.float32(step * rnd.randint(-9, 9))) for _ in range(width)], rnd.choice([None, 1, 2])) for _ in range(count)]
    same(vector_codes.vector_codes(table(spark, rows)), plain_codes(rows))


def test_vector_codes_of_odd_rows(spark):
    one = [0.1 * i for i in range(16)]
    rows = [
        (1, one, None), (1, one, None), (1, one[::-1], 3), (None, one, 3), (None, None, None), (2, None, 1), (3, [], 1), (4, [*one[:15], None], 1),
        (5, [*one[:15], float("nan")], 1), (6, [*one[:15], float("inf")], 1), (7, [*one[:15], 1e30], 1), (8, [1.0] * 32, 1), (9, [-0.001] * 16, -1),
    ]
    want = plain_codes([(i, v, lb) for i, v, lb in rows if v is None or all(x is None or np.isfinite(x) for x in v)])
    assert len(want) == 5
    same(vector_codes.vector_codes(table(spark, rows)), want)
    assert vector_codes.vector_codes(table(spark, [(1, None, 1)])).collect() == []
    assert vector_codes.vector_codes(spark.createDataFrame([], VECTORS)).collect() == []
    with pytest.raises(ValueError, match="16 equal parts"):
        vector_codes.vector_codes(table(spark, [(1, [1.0] * 17, 1)]))


def test_more_rows_of_the_last_id_than_entries(spark):
    rnd = random.Random(4)
    rows = [(None, [float(rnd.randint(-3, 3)) for _ in range(16)], 1) for _ in range(150)]
    same(vector_codes.vector_codes(table(spark, rows, 2)), plain_codes(rows))


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([3, 300, 2**20, 2**26]), st.integers(1, 9))
def test_screening_never_loses_the_nearest(seed, size, width):
    rnd = np.random.default_rng(seed)
    books = rnd.integers(-size, size, (2, 17, width))
    books[:, 5] = books[:, 3]
    x = rnd.integers(-size, size, (40, width))
    # entries one step apart, far from zero: float32 cannot tell them
    x[:20] = books[1, rnd.integers(0, 17, 20)] + rnd.integers(-1, 2, (20, width))
    index, distance = vector_codes.Books(books).nearest(x, 1)
    exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c, strict=True)) for c in books[1]] for v in x]
    assert index.tolist() == [d.index(min(d)) for d in exact] and distance.tolist() == [min(d) for d in exact]


def test_codes_are_decoded_and_columns_kept(spark):
    rnd = random.Random(8)
    rows = [(i, [rnd.random() for _ in range(32)], 1) for i in range(300)]
    df = table(spark, rows).select("vec_id", "embedding", "label")
    books = vector_codes.train(df, parts=8, entries=16)
    coded = vector_codes.encode(df, books)
    assert coded.columns == ["vec_id", "embedding", "label", "code", "error"] and coded.count() == 300
    for r in coded.limit(20).collect():
        gap = (np.floor(np.array(r.embedding) * 256) + 0.5) / 256 - vector_codes.decoded(r.code, books)
        assert len(r.code) == 16 and round(float((gap**2).sum()) * 65536) == r.error


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_manifest(rows, arity=2):
    trees = defaultdict(list)
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
        trees[r[2]].append((r[0], leaf(r), leaf((*r[:3], r[3] + 1, r[4])) if hit else None))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + arity])) for i in range(0, len(out[-1]), arity)])
        return out

    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    for k in order:
        trees[k].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    built = {k: levels([x[1] for x in trees[k]]) for k in order}
    top = levels([built[k][-1][0] for k in order]) if order else []
    out = []
    for g, k in enumerate(order):
        for i, (doc_id, own, changed) in enumerate(trees[k]):
            siblings, up = "", changed or own
            for tree, at in ((built[k], i), (top, g)):
                for level in tree[:-1]:
                    run = level[at // arity * arity : at // arity * arity + arity]
                    rest = run[: at % arity], run[at % arity + 1 :]
                    siblings += "".join(rest[0] + rest[1])
                    up = sha("".join([*rest[0], up, *rest[1]]))
                    at //= arity
            out.append((doc_id, own, built[k][-1][0], top[-1][0], sha(siblings), up, up == top[-1][0]))
    return sorted(out, key=key)


def fields(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=key)


def rows_of(docs):
    return [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]


@pytest.mark.parametrize("count", [1, 2, 3, 5, 64, 65])
def test_manifest_of_small_trees(spark, documents, count):
    docs = documents([(i, f"text {i}", "en", None) for i in range(count)])
    assert fields(merkle.manifest_digest(docs)) == plain_manifest(rows_of(docs))


@pytest.mark.parametrize(("arity", "depth"), [(2, 1), (2, 2), (3, 2), (4, 9)])
def test_manifest_in_blocks_of_any_size(spark, documents, arity, depth):
    rnd = random.Random(arity * 10 + depth)
    docs = documents([(rnd.randrange(500), f"text {i}", rnd.choice([None, "en", "en", "fr", "é", "z", ""]), "s") for i in range(150)])
    made = merkle.Manifest(merkle.leaves(docs), arity, depth)
    assert fields(made.proofs()) == plain_manifest(rows_of(docs), arity)
    stored = made.preimages().collect()
    digests = {sha(r.preimage) for r in stored}
    ends = {r.hash for r in made.roots.collect()} | {r.hash for r in made.root.collect()}
    own = {leaf(r) for r in rows_of(docs)}
    # every child of a stored parent is a leaf or the hash of another stored parent
    assert {r.preimage[i : i + 64] for r in stored for i in range(0, len(r.preimage), 64)} <= digests | own | ends


def test_manifest_of_odd_rows(spark, odd, nothing):
    assert fields(merkle.manifest_digest(odd)) == plain_manifest(rows_of(odd))
    assert merkle.manifest_digest(nothing).collect() == []


def test_every_tampered_leaf_fails_and_no_other(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for r in merkle.manifest_digest(docs).collect():
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0)
