import pytest
from pyspark.sql import types as T

#: documents with a clashing extra column for the names that operators use inside
SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("t", T.StringType()), ("doc", T.StringType()), ("size", T.StringType()), ("key", T.StringType()))]
)


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows, parts=3):
        full = [(i, t, lang, source, None if t is None else len(t), "t", "doc", "size", "key") for i, t, lang, source in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return make


@pytest.fixture(scope="session")
def odd(documents):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, "a b c", "en", "s1"), (1, "a b c", "en", "s1"), (2, "", "en", "s1"), (3, None, None, None), (4, " \t\n ", "fr", None),
        (5, long, "de", "s2"), (6, long, "de", "s2"), (None, "a b c", None, "s1"), (None, None, None, None), (7, "éà ü — 日本語 \U0001f600", "fr", "s2"), (7, "zwei zeilen\n> zitat", "de", "s3"),
    ]
    return documents(rows)


@pytest.fixture(scope="session")
def nothing(documents):
    return documents([], 1)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
