"""The pipeline on planted documents: each stage's decisions against brute force, and run() against all of them."""

import hashlib
import random
from collections import Counter

import pytest
from test_exact import classes, edit_distance_within, removed, words

import corpus_pipeline


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice(["ka", "lo", "mi", "ne", "pu", "ri"]) for _ in range(rnd.randrange(2, 4)))
    item = " ".join(word() for _ in range(22))
    passage = " ".join(word() for _ in range(60))
    rows, labels = [], []
    for i in range(90):
        text = " ".join(word() for _ in range(rnd.randrange(40, 90)))
        if i < 30:
            text += " vile" if i % 2 else ""
            labels.append((i, i % 2))
        elif i in (40, 41):
            text = rows[35][1]  # exact copies
        elif i in (45, 46):
            text = rows[36][1] + " " + word()  # near copies
        elif i in (50, 51, 52):
            text += " " + passage + " " + word()
        elif i in (60, 61):
            text = text[:100] + " " + item.upper() + "! " + text[100:]
        rows.append((i, text, "en", "ab"[i % 2], len(text)))
    labels += [(j, 1) for j in range(1, 30, 2)] * 40  # enough weight for the one bad word
    labels += [(j, 0) for j in range(0, 30, 2)] * 40
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(7, item), (8, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, item


def test_each_stage_by_brute_force(spark, planted):
    folder, item = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "repeated_passages", "decontamination", "mixture"]

    def step(name, frame):
        out = spark.createDataFrame(stages[name](spark, frame, folder).collect(), docs.schema)
        return out, {r.doc_id: r for r in out.collect()}

    before = {r.doc_id: r for r in docs.collect()}
    clean, kept = step("toxicity", docs)
    assert set(kept) == {i for i, r in before.items() if "vile" not in r.text}

    heads = {c for _, c, *_ in classes([(i, r.text) for i, r in kept.items()])}
    single, after = step("near_duplicates", clean)
    assert set(after) == heads and {40, 41, 45, 46}.isdisjoint(heads) and all(after[i] == kept[i] for i in heads)

    cut, shorter = step("repeated_passages", single)
    for (i, n, k, digest), _ in removed([(i, r.text) for i, r in after.items()]).items():
        assert hashlib.sha256(" ".join(words(shorter[i].text)).encode()).hexdigest() == digest and (k >= 60) == (i in (51, 52)) and shorter[i].n_chars == len(shorter[i].text) and n >= k

    free, left = step("decontamination", cut)
    budget = int(0.08 * len(item))
    assert set(left) == {i for i, r in shorter.items() if edit_distance_within(item, " ".join(r.text.lower().replace("!", " ").split())) > budget} and set(shorter) - set(left) == {60}  # 61 repeats the item of 60, which the stage before has cut out of it

    _, mixed = step("mixture", free)
    assert set(mixed) <= set(left)
    whole = Counter((r.doc_id, r.text) for r in corpus_pipeline.run(spark, folder).collect())
    again = Counter((r.doc_id, r.text) for r in stages["mixture"](spark, free, folder).collect())
    assert whole == again and sum(len(words(t)) * n for (_, t), n in whole.items()) == pytest.approx(1.5 * sum(len(words(r.text)) for r in left.values()), rel=0.05)


def test_a_broken_run_goes_on_behind_its_last_stage(spark, tmp_path, monkeypatch):
    rows = [(1, "a"), (2, "b"), (3, "c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    calls, broken = [], [True]

    def stage(name, least):
        def f(spark, docs, sf_dir):
            calls.append(name)
            if name == "three" and broken[0]:
                raise RuntimeError("lost")
            return docs.where(f"doc_id >= {least}")

        return name, f

    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("one", 1), stage("two", 2), stage("three", 3)])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, str(tmp_path), "night")
    broken[0] = False
    assert [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path), "night").collect()] == [3]
    assert calls == ["one", "two", "three", "three"]
    assert [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()] == [3] and len(calls) == 7
