"""Operators that have an exact definition, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from auditloom.llm import decontaminate, fingerprint, jaccard_join, kernel, mixing, quotes, shared, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def test_kernel_words_and_shingles():
    texts = ["a bb  ccc\n", "", "\tx", "é — z"]
    import pyarrow as pa

    data, offsets = kernel.text_buffers(pa.array(texts))
    start, end, hashes, first = kernel.words(data, offsets)
    assert [bytes(data[a:b]).decode() for a, b in zip(start, end, strict=True)] == [w for t in texts for w in words(t)]
    assert np.diff(first).tolist() == [3, 0, 1, 3]
    two, ok = kernel.shingles(hashes, first, 2)
    assert ok.tolist() == [True, True, False, False, True, True, False]
    again = kernel.words(*kernel.text_buffers(pa.array(["q bb ccc"])))[2]
    assert again[1] == hashes[1] and again[2] == hashes[2] and len(set(two[ok].tolist())) == 4


@pytest.mark.parametrize("period", range(1, 40))
def test_difference_cover(period):
    cover = substring_dedup.difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def removed(rows, window=13):
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = words(t)
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), i)
    out = Counter()
    for i, t in rows:
        w, gone = words(t), set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] != i:
                gone |= set(range(p, p + window))
        out[i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()] += 1
    return out


def overlapping(seed, n=120):
    rnd = random.Random(seed)
    passages = [[f"p{rnd.randrange(50)}" for _ in range(rnd.randrange(8, 40))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rnd.randrange(0, 6)):
            p = rnd.choice(passages)
            a = rnd.randrange(len(p))
            w += [f"u{rnd.randrange(9999)}" for _ in range(rnd.randrange(0, 9))] + p[a : a + rnd.randrange(1, 40)]
        rows.append((i, " ".join(w) + rnd.choice(["", "\n", "  "]), "en", "s"))
    return rows


def test_substring_dedup(documents):
    rows = overlapping(1)
    got = substring_dedup.substring_digest(documents(rows))
    assert Counter(tuple(r) for r in got.collect()) == removed([r[:2] for r in rows])
    texts = {r.doc_id: r.text for r in substring_dedup.substring_dedup(documents(rows)).collect()}
    for (i, n, k, digest), _ in removed([r[:2] for r in rows]).items():
        if k == n and n:
            assert i not in texts
        else:
            assert hashlib.sha256(" ".join(words(texts[i])).encode()).hexdigest() == digest
            assert k or texts[i] == rows[i][1]


@pytest.mark.parametrize("keep_first", [True, False])
@pytest.mark.parametrize("slices", [1, 4, 60])
def test_settled_rows_change_nothing(slices, keep_first):
    """Whatever the slices settle among themselves, the same (hash, document) rows come out."""
    import pyarrow as pa

    rnd = np.random.default_rng(slices)
    hashes = rnd.choice(np.array([2, 4, 6, 1 << 63, (1 << 64) - 2, *range(100, 160, 2)], np.uint64), 600, p=[0.3, 0.2, 0.1, 0.05, 0.05, *[0.01] * 30])
    doc = rnd.integers(0, 200, 600)
    dealt = [substring_dedup._dealt(hashes[k::slices], doc[k::slices], keep_first) for k in range(slices)]
    rows = sorted({(h, d) for x in dealt for h, d in zip(*(c.to_pylist() for c in x.columns), strict=True)})
    batches = [pa.record_batch([pa.array(c) for c in zip(*rows[k : k + 7], strict=True)], ["h", "doc"]) for k in range(0, len(rows), 7)]
    got = {(h, d) for x in substring_dedup._shared(keep_first)(batches) for h, d in zip(*(c.to_pylist() for c in x.columns), strict=True)}
    docs = defaultdict(set)
    for h, d in zip(hashes.view(np.int64).tolist(), doc.tolist(), strict=True):
        docs[h].add(d)
    assert got == {(h, d) for h, ds in docs.items() for d in ds if len(ds) > 1 and (keep_first or d > min(ds))}


def test_substring_dedup_null_ids(documents):
    """Rows with null ids are cut by the others, not by each other."""
    rows = [(None if n % 3 else i, *r) for n, (i, *r) in enumerate(overlapping(3))]
    got = substring_dedup.substring_digest(documents(rows))
    assert Counter(tuple(r) for r in got.collect()) == removed([r[:2] for r in rows])


def test_substring_dedup_odd(odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert Counter(tuple(r) for r in substring_dedup.substring_digest(odd).collect()) == removed(rows)
    cut = substring_dedup.substring_dedup(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count() - 1
    assert substring_dedup.substring_digest(nothing).count() == substring_dedup.substring_dedup(nothing).count() == 0


def classes(rows, k=5, threshold=0.8):
    copies = defaultdict(list)
    for i, t in rows:
        copies[t or ""].append(i)
    sets = {t: {tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))} for t in copies if (w := words(t))}
    links, comp = Counter(), {t: {t} for t in sets}
    names = list(sets)
    for n, a in enumerate(names):
        for b in names[:n]:
            c = len(sets[a] & sets[b])
            if c >= threshold * (len(sets[a]) + len(sets[b]) - c) - 1e-9:
                links[a] += 1
                links[b] += 1
                comp[a] |= comp[b]
                for t in comp[a]:
                    comp[t] = comp[a]
    big = lambda i: (i is None, i or 0)
    out = Counter()
    for t, ids in copies.items():
        for i in ids:
            out[(i, min((x for u in comp[t] for x in copies[u]), key=big), links[t], len(ids) - 1) if t in sets else (i, i, 0, 0)] += 1
    return out


def near(seed):
    rnd = random.Random(seed)
    rows = []
    for _ in range(12):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randrange(3, 120))]
        for _ in range(rnd.randrange(1, 30)):
            w = base[:]
            for _ in range(rnd.randrange(0, 6)):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(3000)}"
            rows.append((len(rows), " ".join(w), "en", "s"))
    return rows


def test_jaccard_join(documents, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)  # so that large buckets are dealt over pairs of blocks
    rows = near(2)
    got = jaccard_join.near_duplicate_classes(documents(rows))
    want = classes([r[:2] for r in rows])
    assert Counter(tuple(r) for r in got.collect()) == want
    assert jaccard_join.drop_near_duplicates(documents(rows)).count() == len({c for _, c, *_ in want})


def test_jaccard_recall_on_the_corpus(spark):
    """Every pair of texts of the corpus that reaches the threshold is linked: compared with all pairs."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = Counter(tuple(r) for r in jaccard_join.near_duplicate_classes(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect())
    assert got == classes(rows)


def test_jaccard_hot_text(documents, monkeypatch):
    monkeypatch.setattr(shared, "SMALL_ROWS", 0)
    monkeypatch.setattr(jaccard_join, "join_hot", lambda rows, values, key: shared.join_hot(rows, values, key, 5))
    rows = near(5)
    rows += [(1000 + i, rows[0][1], "en", "s") for i in range(40)]
    assert Counter(tuple(r) for r in jaccard_join.near_duplicate_classes(documents(rows)).collect()) == classes([r[:2] for r in rows])


def test_jaccard_join_odd(odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = Counter(tuple(r) for r in jaccard_join.near_duplicate_classes(odd).collect())
    assert got == classes(rows)
    kept = jaccard_join.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == 8
    assert jaccard_join.near_duplicate_classes(nothing).count() == jaccard_join.drop_near_duplicates(nothing).count() == 0


def test_pruning_keeps_what_reaches_the_threshold():
    need = jaccard_join.needed_matches(0.8, 1e-6)
    assert (np.diff(need) > 0).all() and need[-1] < 0.8 * jaccard_join.HASHES


def mixed(rows):
    size = {n: len(words(t)) for n, (_, t, _) in enumerate(rows)}
    total = Counter()
    for n, (_, _, s) in enumerate(rows):
        total[s] += size[n]
    order = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + ([None] if None in total else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(total.values())
    while free:
        share = sum(weight[s] for s in free)
        full = {s for s in free if left * weight[s] / share > 2 * total[s]}
        if not full:
            target |= {s: left * weight[s] / share for s in free}
            break
        target |= {s: 2.0 * total[s] for s in full}
        left -= sum(2 * total[s] for s in full)
        free -= full
    return size, total, target


@pytest.mark.parametrize("seed", range(3))
def test_mixing(documents, seed):
    rnd = random.Random(seed)
    sources = ["b", "a", "é", None, "c", "d"]
    rows = [(i, " ".join("w" * rnd.randrange(0, 200)), "en", rnd.choice(sources[: 2 + 2 * seed] + ["a"] * 4)) for i in range(600)]
    docs = documents(rows)
    got = {r.doc_id: r for r in mixing.mix_sizes(docs).collect()}
    size, total, target = mixed([(r[0], r[1], r[3]) for r in rows])
    taken = Counter()
    for i, _, _, s in rows:
        r = got[i]
        assert (r.size, r.source_size) == (size[i], total[s]) and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 200 for s in target)
    again = {r.doc_id: r for r in mixing.mix_sizes(documents(rows, 5)).collect()}
    assert got == again
    copies = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert all(copies[i] * r.size == r.taken for i, r in got.items())


def test_pareto_ranks_by_odds(documents):
    docs = documents([(i, "w " * 10, "en", "ab"[i % 2]) for i in range(400)])
    rows = mixing.mix_sizes(docs).collect()
    rate = {s: sum(r.taken for r in rows if r.doc_id % 2 == k) / 2000 for k, s in enumerate("ab")}
    assert rate["a"] == pytest.approx(2.0) and rate["b"] == pytest.approx(1.0)


@pytest.mark.parametrize("bins", [4096, 16])
def test_mixing_shared_ids(documents, monkeypatch, bins):
    """Null and repeated ids, and equal rows: each source comes within one document of its target all the same."""
    monkeypatch.setattr(mixing, "BINS", bins)
    monkeypatch.setattr(mixing, "FEW", 3)  # so that bins are refined
    rows = [(None if i % 2 else 7, f"t{i % 5} " * 10, "en", "abc"[i % 3]) for i in range(400)]
    rows += [(None, "x " * 10, "en", "d")] * 90 + [(i, "y " * 10, "en", "d") for i in range(30)]
    got = mixing.mix_sizes(documents(rows)).collect()
    _, total, target = mixed([(n, t, s) for n, (_, t, _, s) in enumerate(rows)])
    taken, source_of = Counter(), {v: k for k, v in total.items()}
    assert len(got) == len(rows)
    for r in got:
        assert r.taken in (0, 10, 20) and r.size == 10
    for s in total:
        taken[s] = sum(r.taken for r in got if r.source_size == total[s])
        alike = [x for x in total if total[x] == total[s]]
        assert abs(taken[s] - sum(target[x] for x in alike)) <= 10 * len(alike)
    assert source_of and mixing.mix(documents(rows)).count() == sum(r.taken for r in got) // 10
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix_sizes(documents(rows, 7)).collect()))


def test_mixing_of_many_sources(documents):
    """The level of the targets is that of water-filling over any number of sources."""
    rnd = random.Random(9)
    rows = [(i, "w " * rnd.randrange(0, 60), "en", f"h{rnd.randrange(90) ** 2 % 97}") for i in range(700)]
    got = mixing.mix_sizes(documents(rows)).collect()
    size, total, target = mixed([(r[0], r[1], r[3]) for r in rows])
    assert all(r.target == pytest.approx(target[rows[r.doc_id][3]]) and r.size == size[r.doc_id] for r in got)


def test_mixing_odd(odd, nothing):
    got = mixing.mix_sizes(odd).collect()
    assert len(got) == odd.count() and all(0 <= r.taken <= 2 * r.size for r in got)
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.mix_sizes(nothing).count() == mixing.mix(nothing).count() == 0


def test_fingerprints(documents, odd, nothing):
    rows = overlapping(4, 60)
    for docs in (documents(rows), odd):
        table = [(r.doc_id, r.text or "") for r in docs.collect()]
        order = sorted(table, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()), reverse=True)
        want = Counter()
        for n, (i, t) in enumerate(order):
            following = order[(n + 1) % len(order)][1]
            half = len(t) // 2
            want[i, len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()] += 1
        got = fingerprint.fingerprints(docs).collect()
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) == 2 + 2 * fingerprint.BUCKETS // 4 for r in got)
        by_text = defaultdict(set)
        for r in fingerprint.digest_column(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
            by_text[r.doc_id].add(r.fingerprint)
        assert all(r.fingerprint in by_text[r.doc_id] for r in got if r.doc_id is not None)
    assert fingerprint.fingerprints(nothing).count() == 0
    assert fingerprint.fingerprints(documents([(1, "alone", "en", "s")])).count() == 1


def naive_digest(text):
    """Bucket quartiles and length code by plain counting."""
    raw, counts = text.encode(), [0] * fingerprint.BUCKETS
    for i in range(len(raw)):
        for kind, (_, b, c) in enumerate(fingerprint.TRIPLETS):
            if i + c < len(raw):
                h = raw[i] | raw[i + b] << 8 | raw[i + c] << 16 | kind << 24
                h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
                h = (h ^ h >> 12) * 0x297A2D39 & 0xFFFFFFFF
                counts[h >> 24] += 1
    ranked = sorted(counts)
    edges = [ranked[q * fingerprint.BUCKETS // 4 - 1] for q in (1, 2, 3)]
    length = min(255, int(np.log1p(len(raw)) / np.log(1.15)))
    return length, [sum(n > e for e in edges) for n in counts]


def test_fingerprint_digest_by_plain_counting(documents):
    texts = ["", "ab", "abc", "a cat sat on the mat", "éà ü — 日本語 " * 9, "a cat sat on the mat " * 40, "x" * 3000]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in fingerprint.fingerprints(documents(rows)).collect()}
    digest = {i: naive_digest(t) for i, t in enumerate(texts)}
    pack = lambda d: bytes([d[0], *(sum(c << 2 * j for j, c in enumerate(d[1][k : k + 4])) for k in range(0, fingerprint.BUCKETS, 4))]).hex()

    def like(a, b):
        apart = sum(abs(x - y) for x, y in zip(a[1], b[1], strict=True)) + fingerprint.LENGTH_WEIGHT * min(abs(a[0] - b[0]), fingerprint.LENGTH_STEPS)
        return 1 - apart / (3 * fingerprint.BUCKETS + fingerprint.LENGTH_WEIGHT * fingerprint.LENGTH_STEPS)

    for i, t in enumerate(texts):
        after = texts[i - 1] if i else texts[-1]
        half = len(t) // 2
        edited = naive_digest(t[: len(t) - half] + after[:half])
        assert got[i].fingerprint == pack(digest[i]) and got[i].edited_fingerprint == pack(edited)
        assert got[i].near_edited == pytest.approx(like(digest[i], edited)) and got[i].near_next == pytest.approx(like(digest[i], naive_digest(after)))


def test_fingerprint_likeness_follows_edits(spark, sf):
    got = fingerprint.fingerprints(spark.read.parquet(f"{sf}/documents.parquet")).toPandas()
    assert (got.near_edited >= got.near_next).mean() > 0.97


def edit_distance_within(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination(spark, documents):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice(["th", "er", "on", "an", "re", "he"]) for _ in range(rnd.randrange(1, 5)))
    items = [(n, " ".join(word() for _ in range(rnd.randrange(8, 30)))) for n in range(12)] + [(100, None), (101, "Short one"), (None, "the"), (102, " - ")]
    rows = []
    for i in range(150):
        text = " ".join(word() for _ in range(rnd.randrange(0, 60)))
        if i % 3 == 0:
            item = rnd.choice(items[:12])[1]
            letters = list(item)
            for _ in range(rnd.randrange(0, 1 + len(item) // 8)):
                at = rnd.randrange(len(letters))
                letters[at : at + 1] = rnd.choice([[], ["q"], [letters[at], "z"]])
            text = text[: len(text) // 2] + " " + rnd.choice([str.upper, str])("".join(letters)) + " " + text[len(text) // 2 :]
        text += rnd.choice(["", "", " short, ONE", " shorter one", " the"])
        rows.append((i, text, "en", "s"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(rows)
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.contaminated(docs, bench).collect()}
    clean = lambda t: re.sub(r"[^0-9a-z\x80-\U0010ffff]+", " ", t.lower())
    want = {}
    for i, t, *_ in rows:
        for n, x in [items[13], items[14]]:
            if re.search(rf"(?<!\S){clean(x)}(?!\S)", clean(t)):
                want[i, n] = 0
        for n, x in items[:12]:
            p = clean(x).strip()
            budget = max(0, min(int(0.08 * len(p)), (len(p) - 11) // 8))
            d = edit_distance_within(p, clean(t))
            if d <= budget:
                want[i, n] = d
    assert got == want and len(want) > 20 and any(want.values()) and {None, 101} < {n for _, n in want}
    kept = decontaminate.drop_contaminated(docs, bench)
    assert {r.doc_id for r in kept.collect()} == set(range(150)) - {i for i, _ in want}


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_decontamination_does_not_depend_on_the_batch(spark, documents, parts):
    items = spark.createDataFrame([(1, "ΤΕΛΟΣ"), (2, "ΚΑΛΟΣ ΛΟΓΟΣ"), (3, "ЖЁЛТЫЙ ДОМ стоит у самой реки за городом")], "item_id long, text string")
    rows = [(1, "x ΤΕΛΟΣ", "el", "s"), (2, "abc", "en", "s"), (3, "ένας καλος λογος", "el", "s"), (4, "İstanbul", "tr", "s"), (5, "и жёлтый дом стоит у самой реки за городом.", "ru", "s"), (6, "τελοσ", "el", "s")]
    got = decontaminate.contaminated(documents(rows, parts).orderBy("doc_id").coalesce(parts), items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (3, 2), (5, 3), (6, 1)}


def test_decontamination_odd(spark, odd, nothing):
    bench = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13"), (2, None), (None, "")], "item_id long, text string")
    assert Counter((r.doc_id, r.item_id) for r in decontaminate.contaminated(odd, bench).collect()) == {(5, 1): 1, (6, 1): 1}
    kept = decontaminate.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(nothing, bench).count() == decontaminate.drop_contaminated(nothing, bench).count() == 0


def test_decontamination_in_blocks(spark, documents, monkeypatch):
    """However many blocks the items take, the same rows come out; other alphabets are lower-cased in place."""
    items = [(i, f"элемент номер {i} из набора проверочных вопросов {i * i}") for i in range(9)] + [(50, "Où est le chat")]
    texts = [f"до {t.upper()} после" if i % 2 else f"İ {t}." for i, t in items] + ["nothing here", "ELEMENT"]
    docs = documents([(i, t, "ru", "s") for i, t in enumerate(texts)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = Counter(tuple(r) for r in decontaminate.contaminated(docs, bench).collect())
    assert {(r[0], r[1]) for r in whole if r[2] == 0} >= {(n, i) for n, (i, _) in enumerate(items)}
    for doc, item, edits, _, start, end in whole:
        if edits == 0:
            assert texts[doc].encode()[start:end].decode().lower() == dict(items)[item].lower()
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 150)
    assert Counter(tuple(r) for r in decontaminate.contaminated(docs, bench).collect()) == whole
    assert decontaminate.drop_contaminated(docs, bench).count() == 2


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Where is the key?\nI need it."),
        (1, 1, "bot", "Which key do you mean?"),
        (1, 2, "user", "> which  KEY do you mean?\nThe red one."),
        (1, 3, "bot", ">> Which key do you mean?\n> The red one.\nOn the shelf."),
        (1, 4, "user", "> Where is the key?\nSame question."),
        (1, 5, "bot", "Also on the shelf."),
        (2, 0, "user", "> Where is the key?\nno such line here"),
        (2, 0, None, None),
        (None, None, "user", "alone"),
    ]
    got = quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    table = {(r.conv_id, r.turn, r.role): r for r in got}
    assert len(got) == len(rows)
    assert [(table[1, n, x].parent_turn, table[1, n, x].linked_by, table[1, n, x].thread_turn) for n, x in enumerate(["user", "bot"] * 3)] == [
        (None, None, 0), (0, "previous", 0), (1, "quote", 0), (2, "quote", 0), (0, "quote", 0), (4, "previous", 0),
    ]
    assert table[1, 2, "user"].text == "The red one." and table[1, 3, "bot"].n_quoted_lines == 2
    assert table[2, 0, "user"].parent_turn is None and table[2, 0, None].text == ""
    assert sorted(r.position for r in got if r.conv_id == 1) == [1, 2, 3, 4, 5, 6]
    assert quotes.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def mail(seed, hot=0):
    """Conversations in which replies quote earlier messages: nested, wrapped anew, cut at the start, in capitals."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for conv in [*range(12), None]:
        said = []
        for turn in range(hot if conv == 3 and hot else rnd.randrange(1, 14)):
            parts = []
            for _ in range(rnd.randrange(0, 3) if said else 0):
                level, quoted = rnd.randrange(1, 4), rnd.choice(said).split()
                quoted = quoted[rnd.randrange(max(1, len(quoted) - 6)) :]
                width = rnd.choice([3, 7, 99])
                mark = rnd.choice(["> " * level, ">" * level + " "])
                parts += [mark + rnd.choice([str.upper, str])(" ".join(quoted[k : k + width])) for k in range(0, len(quoted), width)]
                parts += rnd.choice([[], [""], ["thanks"]])
            own = " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 25)))
            said.append(own)
            rows.append((conv, turn * rnd.choice([1, 1, 3]), rnd.choice(["user", "bot", None]), rnd.choice(["\n", "\r\n"]).join([*parts, own])))
    return rows + rows[:3] + [(None, None, "user", "alone"), (None, None, None, None), (5, None, "user", "> w1 w2 w3 w4 w5")] * 2


def brute_threads(rows):
    """Conversations by definition: (conv, position, thread, turn, role, text, parent, how, quoted lines)."""
    level_of = lambda x: re.match(r"\s*((?:>[ \t]*)*)", x).group(1).count(">")
    normal = lambda x: re.sub(r"\s+", " ", re.sub(r"^\s*((?:>[ \t]*)+)", "", x).lower()).strip()

    def runs(text):
        units, last = [], None
        for line in re.split(r"\r?\n", text or ""):
            words = normal(line).split()
            if level_of(line) != last:
                units.append((level_of(line), []))
                last = level_of(line)
            units[-1][1].extend(words)
            if 0 < len(words) < quotes.RUN:
                units.insert(0, (last, words))
        return {(lv, tuple(w[i : i + quotes.RUN])) for lv, w in units if w for i in range(max(1, len(w) - quotes.RUN + 1))}

    key = lambda v: (v is not None, v if v is not None else 0)
    out = Counter()
    by_conv = defaultdict(list)
    for r in rows:
        by_conv[r[0]].append(r)
    for conv, own in by_conv.items():
        mark = lambda r: (r[3] is not None, hashlib.md5((r[3] or "").encode()).hexdigest() if r[3] is not None else "")
        own.sort(key=lambda r: (key(r[1]), mark(r), (r[2] is not None, r[2] or "")))
        have = [runs(r[3]) for r in own]
        written = defaultdict(set)
        for r, h in zip(own, have, strict=True):
            if r[1] is not None:
                for lv, w in h:
                    if lv == 0:
                        written[w].add(r[1])
        link = []
        for r, h in zip(own, have, strict=True):
            votes = Counter()
            for lv, w in h:
                earlier = [t for t in written[w] if r[1] is not None and t < r[1]] if lv else []
                if earlier:
                    votes[lv, max(earlier)] += 1
            link.append(max(((-lv, n, t) for (lv, t), n in votes.items()), default=(0, 0, None))[2])
        branch, opener = [], None
        for r, q in zip(own, link, strict=True):
            opener = r[1] if q is not None else opener
            branch.append(opener if opener is not None else own[0][1])
        home, quoted = {}, {}
        for r, b, q in zip(own, branch, link, strict=True):
            if b is not None:
                home[r[1]] = max(home.get(r[1], b), b)
            if q is not None:
                quoted[r[1]] = max(quoted.get(r[1], q), q)

        def thread(b):
            while b in quoted and home.get(b) == b and home.get(quoted[b]) is not None and home[quoted[b]] != b:
                b = home[quoted[b]]
            return b

        threads = [thread(b) for b in branch]
        order = sorted(range(len(own)), key=lambda i: (key(threads[i]), i))
        for position, i in enumerate(order, 1):
            r, q = own[i], link[i]
            before = own[i - 1][1] if i else None
            parent = q if q is not None else before if before is not None and r[1] is not None and before < r[1] else None
            lines = re.split(r"\r?\n", r[3] or "")
            kept = re.sub(r"^\s+|\s+$", "", "\n".join(x for x in lines if not level_of(x)))
            how = "quote" if q is not None else "previous" if parent is not None else None
            out[conv, position, threads[i], r[1], r[2], kept, parent, how, sum(level_of(x) > 0 for x in lines)] += 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_quotes_against_brute_force(spark, seed):
    rows = mail(seed, hot=60 if seed == 1 else 0)
    frame = spark.createDataFrame([(*r, "clash", 7) for r in rows], "conv_id long, turn long, role string, text string, run string, n int").repartition(5)
    got = Counter(tuple(r) for r in quotes.conversations(frame).collect())
    want = brute_threads(rows)
    assert got == want
    assert sum(n for r, n in want.items() if r[7] == "quote") > 20


def test_quotes_sql_on_quoted_mail(spark):
    import duckdb

    from auditloom.llm import queries

    rows = mail(7)
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = Counter(db.execute(queries.oracle_sql()["op7_quotation_linking"]).fetchall())
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert Counter(tuple(r) for r in quotes.conversations(frame).collect()) == want


def test_quotes_of_very_long_texts(spark):
    long = " ".join(f"w{i % 9973}" for i in range(40_000))
    wrapped = "\n".join("> " + " ".join(long.split()[k : k + 11]) for k in range(20_000, 40_000, 11))
    frame = spark.createDataFrame([(1, 0, "a", long), (1, 1, "b", "no"), (1, 2, "a", wrapped + "\nyes")], "conv_id long, turn long, role string, text string")
    got = {r.turn: r for r in quotes.conversations(frame).collect()}
    assert (got[2].parent_turn, got[2].linked_by, got[2].text) == (0, "quote", "yes") and got[1].parent_turn == 0
