"""Queries over pages of which several have the same url, against DuckDB."""

from collections import Counter

import duckdb
import pytest

from auditloom import plans


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("repeated"))
    html = ["<ul><li>a<li>b</ul><p>c", "<p>a</p><p>b</p>", "", "no tags", None]
    urls = ["https://a.org/x", "https://a.org/x#top", "https://b.org/", "http://c.org/y?q=1", "https://A.org/x"]
    pages = [(n, urls[n * 7 % 11 % 5], html[n % 5]) for n in range(400)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).write.parquet(f"{folder}/pages.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    return folder, connection


@pytest.mark.parametrize("name", ["element_counts", "eligible_pages", "jsonld_types", "report_sitemap"])
def test_pages_of_one_url_are_counted_apart(spark, repeated, name):
    folder, connection = repeated
    frame = plans.queries()[name](spark, folder)
    result = connection.execute(plans.oracle_sql()[name])
    places = [[d[0] for d in result.description].index(c) for c in frame.columns]
    assert Counter(map(tuple, frame.collect())) == Counter(tuple(r[i] for i in places) for r in result.fetchall())
