"""Stored indexes that imports keep up to date equal those built anew."""

import random

import pytest
from pyspark.sql import functions as F

from shellac.functions import derived_columns
from shellac.operators import diff, facets, postings, search
from shellac.schema import SOURCE_FIELDS
from shellac.storage import stored
from test_jobs import source


@pytest.fixture(scope="module")
def imports(spark):
    """A catalogue and what three imports delete and insert, with the catalogue after each."""
    rng = random.Random(4)
    artists = ["Ann", "ann", "Bob", "Éva", "7 Up", None, "Dubious Entry", "Zed"]
    rows = [{"artist": rng.choice(artists), "title": f"Song {rng.randrange(60)}", "year": rng.choice(["1970", None, "71"]), "matrix_number": f"M{i}"} for i in range(300)]
    live = source(spark, rows, "id").withColumns(derived_columns())
    steps, now = [], live
    for k in range(3):
        rows = [r | ({"artist": rng.choice(artists)} if rng.random() < 0.1 else {}) for r in rows if rng.random() > 0.1] + [{"artist": f"New {k}", "title": "x", "matrix_number": f"N{k}{i}"} for i in range(5)]
        target = source(spark, rows)
        d = stored(diff.multiset_diff(now, target), "diff")
        after = stored(diff.apply_diff(now.select("id", *SOURCE_FIELDS), target, d).withColumns(derived_columns()), "after")
        steps.append((now.join(d.filter("status = 'delete'").select("id"), "id", "left_semi"), after.join(now.select("id"), "id", "left_anti"), after))
        now = after
    return live, steps


def rows_of(df, *columns):
    return sorted(repr(tuple(r)) for r in df.select(*columns).collect())


def test_facets_after_three_imports(imports):
    live, steps = imports
    table = facets.facet_table(live)
    for deleted, inserted, after in steps:
        table = stored(facets.by_range(facets.updated_facets(table, deleted, inserted, after)), "facets")
        assert rows_of(table, "facet", "value", "id", "label", "n") == rows_of(facets.facet_table(after), "facet", "value", "id", "label", "n")
    now = steps[-1][2]
    for letter in (None, "a", "#", "n"):
        assert rows_of(facets.index_range(table, "artists", letter), "value", "label", "n") == rows_of(facets.facet_index(now, "artists", letter), "value", "label", "n")
    plan = facets.index_range(table, "artists", "b")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(value,b)" in plan[plan.index("PushedFilters") :]


def test_facets_of_empty_sides(imports):
    live, _ = imports
    none = live.limit(0)
    table = facets.facet_table(live)
    assert rows_of(facets.updated_facets(table, none, none, live), *table.columns) == rows_of(table, *table.columns)
    assert facets.updated_facets(table, live, none, none).count() == 0
    assert rows_of(facets.updated_facets(table.limit(0), none, live, live), *table.columns) == rows_of(table, *table.columns)


def test_postings_after_three_imports(spark, imports, tmp_path):
    live, steps = imports
    manifest = postings.publish_postings(live, f"file://{tmp_path}", 64)
    for deleted, inserted, after in steps:
        before = {r["block"]: r["folder"] for r in manifest.collect()}
        manifest = postings.update_postings(manifest, deleted, inserted, f"file://{tmp_path}", 64)
        index = postings.read_postings(spark, manifest)
        assert rows_of(index, "block", "piece", "ids") == rows_of(postings.postings(after, 64), "block", "piece", "ids")
        touched = {r["id"] // 64 for side in (deleted, inserted) for r in side.collect()}
        assert {b for b, f in before.items() if {r["block"]: r["folder"] for r in manifest.collect()}.get(b) != f} <= touched
    # an import of which only the last block knows leaves all other files alone
    last = steps[-1][2].agg(F.max("id")).first()[0]
    more = source(spark, [{"title": "after all"}], "id").withColumn("id", F.lit(last + 1))
    again = {r["block"]: r["folder"] for r in postings.update_postings(manifest, more.limit(0), more, f"file://{tmp_path}", 64).collect()}
    was = {r["block"]: r["folder"] for r in manifest.collect()}
    assert [b for b, f in again.items() if was.get(b) != f] == [(last + 1) // 64]
    # a block that loses all of its rows leaves the manifest
    gone = steps[-1][2].filter("id < 64")
    assert 0 not in {r["block"] for r in postings.update_postings(manifest, gone, gone.limit(0), f"file://{tmp_path}", 64).collect()}


def test_bulk_search_by_postings(spark, imports, tmp_path):
    live, _ = imports
    queries = spark.createDataFrame(list(enumerate(["ann", "song 1", "SONG 12", "m1", "m299", "bob", "nn", "", None, "éva", "nowhere at all", "song 1", "7 u"])), "query_id long, q string")
    index = postings.read_postings(spark, postings.publish_postings(live, f"file://{tmp_path}", 50))
    got = search.bulk_search(live, queries, lambda terms: postings.candidates(index, terms))
    want = queries.crossJoin(live).filter(search.substring_match(F.col("q")))
    assert rows_of(got, "query_id", "id") == rows_of(want, "query_id", "id") == rows_of(search.bulk_search(live, queries), "query_id", "id")
    empty = postings.read_postings(spark, postings.publish_postings(live.limit(0), f"file://{tmp_path}", 50))
    assert search.bulk_search(live.limit(0), queries, lambda terms: postings.candidates(empty, terms)).count() == 0
