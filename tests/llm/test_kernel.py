"""Property tests of the vectorised primitives, and of component labels."""

import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from auditloom.llm import decontaminate, fingerprint, kernel, kneser_ney, lookup
from auditloom.llm.shared import min_labels

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("ab \n\té日\x0b😀.")), st.text()), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_words_are_those_of_the_pattern(texts, k):
    data, offsets = kernel.text_buffers(pa.array(texts, pa.string()))
    start, end, hashes, first = kernel.words(data, offsets)
    mine = [bytes(data[a:b]).decode() for a, b in zip(start, end, strict=True)]
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert mine == [w for words in split for w in words]
    assert np.diff(first).tolist() == [len(w) for w in split]
    by_word = {}
    assert all(by_word.setdefault(w, h) == h for w, h in zip(mine, hashes.tolist(), strict=True))
    gram, whole = kernel.shingles(hashes, first, k)
    want = [tuple(w[i : i + k]) for w in split for i in range(len(w) - k + 1)]
    assert whole.sum() == len(want) and len(set(gram[whole].tolist())) == len(set(want))


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_slices_cover_every_document_once(texts, size):
    column = pa.array(texts, pa.string())
    rows = [(a, b) for a, b, _, _ in kernel.text_slices(column, size)]
    assert [i for a, b in rows for i in range(a, b)] == list(range(len(texts)))
    joined = b"".join(bytes(d) for _, _, d, _ in kernel.text_slices(column, size))
    assert joined == "".join(t or "" for t in texts).encode()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(min_size=1, max_size=6), max_size=60))
def test_lookup_finds_exactly_the_known_keys(grams):
    keys = np.unique(kneser_ney.hash_grams(pa.array(sorted(set(grams)), pa.string())))
    wanted = np.concatenate([keys, keys + np.uint64(1)])
    at, known = lookup.place(keys, wanted)
    assert (known == np.isin(wanted, keys)).all()
    assert (keys[at[known]] == wanted[known]).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=80), min_size=2, max_size=6))
def test_digests_do_not_depend_on_the_batch(texts):
    one = [fingerprint._digest_texts(pa.array([t])) for t in texts]
    all_at_once = fingerprint._digest_texts(pa.array(texts))
    assert (np.concatenate(one) == all_at_once).all()
    score = fingerprint.likeness(all_at_once[:1].repeat(len(texts), 0), all_at_once)
    assert score[0] == 1 and ((0 <= score) & (score <= 1)).all()


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_normalised_text_keeps_its_places(texts):
    data, offsets = kernel.text_buffers(pa.array(texts, pa.string()))
    clean, first, place = decontaminate.normalised(data, offsets)
    assert len(clean) == len(place) and first[-1] == len(clean)
    folded = decontaminate.lowered(data)
    assert len(folded) == len(data)
    terms = kernel.IS_TERM[data[place]]
    assert (clean[terms] == kernel.LOWER[folded[place]][terms]).all() and (clean[~terms] == 32).all()


GREEK = st.lists(st.text(alphabet=st.sampled_from("ΣσςΤΕΛΟ ßİIıéÉЖжaZ.\u1e9e\U00010400")), min_size=1, max_size=6)


@settings(max_examples=150, deadline=None)
@given(GREEK)
def test_a_text_is_folded_alike_whatever_stands_beside_it(texts):
    data, offsets = kernel.text_buffers(pa.array(texts, pa.string()))
    together = decontaminate.lowered(data)
    for i, text in enumerate(texts):
        alone = decontaminate.lowered(np.frombuffer(text.encode(), np.uint8))
        assert bytes(together[offsets[i] : offsets[i + 1]]) == bytes(alone)


def test_component_labels(spark):
    rnd = random.Random(6)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in min_labels(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for a, b in edges for v in (a, b) if a != b}
