"""Near misses in spelling against comparing all pairs."""

import random

import pytest

from auditloom.operators import similarity


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize(("distance", "letters", "longest"), [(1, "ab", 6), (2, "abc", 8)])
def test_near_misses_are_those_of_all_pairs(spark, distance, letters, longest):
    rnd = random.Random(distance * 100 + longest)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randrange(1, longest + 1))): rnd.randrange(1, 9) for _ in range(150)}
    frame = spark.createDataFrame(sorted(words.items()), "word string, n int").repartition(3)
    known = frame.where("n >= 4")
    got = similarity.near_misses(frame, distance, known).collect()
    want = {(a, b, edits(a, b)) for a, n in words.items() for b, m in words.items() if m >= 4 and n < m and a != b and edits(a, b) <= distance}
    assert {(r.word, r.suggestion, r.distance) for r in got} == want and len(got) == len(want)
    assert similarity.near_misses(frame.limit(0), distance, known).count() == 0


def test_keys_are_one_long_for_each_choice_of_letters(spark):
    frame = spark.createDataFrame([("abcdefgh", 1), ("abcdefgi", 9), ("", 9), (None, 9), ("über", 1), ("uber", 9)], "word string, n int")
    found = similarity.near_misses(frame, 2)
    assert {tuple(r) for r in found.collect()} == {("abcdefgh", "abcdefgi", 1), ("über", "uber", 1)}
    keys = {r.word: r.k for r in frame.where("word IS NOT NULL").select("word", similarity.deletion_keys(2)("word").alias("k")).collect()}
    assert len(keys["abcdefgh"]) == 1 + 8 + 28 and len(keys[""]) == 1
