"""Catalogue queries against their DuckDB SQL on the smallest driver tables."""

import os

import pytest

import __spark_entry__ as entry
from shellac.operators import diff
from shellac.plans import registry

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
SOME = [
    "record_key", "content_hash", "release_base", "shared_prefix", "page_metadata", "facet_value", "flip_side", "phrase_match", "keyword_search", "field_search", "bm25_rank", "bulk_search", "deep_page", "blocks_edited", "blocks_deleted", "blocks_withdrawn", "csv_round_trip", "csv_line_ends", "facet_table_updated", "postings_updated", "multiset_diff_copies", "apply_edits_added", "dismiss_mismatches", "list_dismissed",
    "facet_index_labels", "facet_indexes", "facet_letter_other", "facet_unknown", "facet_rows", "target_catalogue", "apply_edits_rows", "apply_edits_overrides", "delete_records_tombstones", "remove_overrides",
    "multiset_diff", "apply_diff", "matrix_mismatches", "release_siblings", "release_tracks", "category_suggestions", "resolve_live_ids", "review_log", "sitemap_chunks", "crawl_guard", "request_limiter", "login_lockout", "request_limiter_ranges", "stream_crawl_guard", "stream_request_limiter",
]


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    made.execute("SET timezone = 'UTC'")
    for t in ("orders", "part", "supplier", "customer", "events", "documents"):
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return made


def plain(rows):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", SOME)
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]}) AS t").fetchall()
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(want)


@pytest.mark.parametrize("name", ["net_reversal", "reconstruct_before", "can_reconstruct"])
def test_history_beyond_the_kept_payload(spark, duck, monkeypatch, name):
    monkeypatch.setattr(diff, "KEPT_PAYLOAD", 100)
    test_query(spark, duck, name)


def test_every_catalogue_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry(spark):
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
