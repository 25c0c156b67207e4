"""Sides of joins that were counted as large are not broadcast, whatever Spark estimates from their files."""

from pyspark.sql import functions as F

from shellac import storage
from shellac.operators import edit_log
from shellac.plans import fixtures, registry

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def few(monkeypatch, *modules):
    """The bound of what is broadcast is three rows."""
    for m in modules:
        monkeypatch.setattr(m, "sized", lambda df: storage.sized(df, 3))


def test_sized(spark):
    rows = storage.stored(spark.range(100).select("id", *(F.lit("x").alias(f"c{i}") for i in range(30))), "wide")
    for most, joined in ((100, "BroadcastHashJoin"), (99, "SortMergeJoin")):
        for how in ("inner", "left", "left_semi", "left_anti"):
            assert joined in plan(spark.range(50).join(storage.sized(rows.select("id"), most), "id", how))


def test_log_is_joined_by_a_shuffle(spark, monkeypatch):
    cat = fixtures.catalogue(spark, DATA)
    few(monkeypatch, fixtures)
    monkeypatch.setattr(fixtures, "catalogue", lambda spark, sf_dir: cat)
    monkeypatch.setattr(fixtures, "table", lambda spark, sf_dir, name, make: make())
    made = plan(fixtures.log(spark, DATA))
    assert "SortMergeJoin" in made and "Broadcast" not in made


def test_reports_on_the_log(spark, monkeypatch):
    log, cat = fixtures.log(spark, DATA), fixtures.catalogue(spark, DATA)
    few(monkeypatch, edit_log)
    live = plan(edit_log.resolve_live_ids(log, cat))
    review = plan(edit_log.review_log(log, log.filter("id % 6 < 3").select("id", F.lit(True).alias("reviewed"), F.lit("x").alias("note")), "zoe", registry.NOW))
    assert "Broadcast" not in live + review


def test_rows_of_an_import(spark, monkeypatch):
    few(monkeypatch, registry)
    deleted, inserted, _ = registry._imported(spark, DATA)
    assert "Broadcast" not in plan(deleted) + plan(inserted)
