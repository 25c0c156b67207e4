"""Bulk searches make the pairs of queries and rows last, and shuffle none of them."""

import pytest

from shellac.functions import derived_columns
from shellac.operators import postings, search
from test_jobs import source

Q = "query_id long, q string"


@pytest.fixture(scope="module")
def cat(spark):
    rows = [{"title": f"{'red' if i % 3 else 'blue'} widget {i}", "matrix_number": f"MX {i:06d}"} for i in range(60)]
    return source(spark, rows, "id").withColumns(derived_columns())


def ways(cat, queries, tmp_path):
    index = postings.read_postings(cat.sparkSession, postings.publish_postings(cat, f"file://{tmp_path}/p", 16))
    return search.bulk_search(cat, queries), search.bulk_search(cat, queries, lambda terms: postings.candidates(index, terms))


def wanted(cat, asked):
    rows = [(r["id"], f"{r['title']}\1{r['matrix_number']}".lower()) for r in cat.collect()]
    return sorted({(k, i) for k, q in asked for i, text in rows if q.lower() in text}, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("bound", [1000, 5])
def test_pairs_are_not_shuffled(spark, cat, tmp_path, monkeypatch, bound):
    """Many queries of few terms, in lists of a few each; their terms broadcast, or not."""
    monkeypatch.setattr(search, "TERM_QUERIES", 7)
    monkeypatch.setattr(search, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(search, "BROADCAST_TERMS", bound)
    asked = [(k, ("Red Widget", "blue widget", "MX 00001", "no such row")[k % 4]) for k in range(80)] + [(k, f"MX {k:06d}") for k in range(100, 110)]
    for found in ways(cat, spark.createDataFrame(asked, Q), tmp_path):
        assert got(found) == wanted(cat, asked)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate explode(_queries" in plan and not plan.startswith("Aggregate")


def test_queries_with_several_terms_or_without_an_id(spark, cat, tmp_path):
    asked = [(1, "red widget"), (1, "MX 0000"), (1, "red widget"), (2, "widget 5"), (None, "widget 7"), (None, "widget 7"), (3, "red widget")]
    for found in ways(cat, spark.createDataFrame(asked, Q), tmp_path):
        assert got(found) == wanted(cat, asked)
    assert search.bulk_search(cat, spark.createDataFrame([], Q)).count() == 0 == search.bulk_search(cat.limit(0), spark.createDataFrame(asked, Q)).count()
