"""Orders that two queries share with their SQL, also where it decides which rows they list."""

from shellac import streaming
from shellac.operators import search
from shellac.plans import registry


def test_many_hits_without_a_sort_come_by_id(spark, monkeypatch):
    monkeypatch.setattr(search, "SORTED_UP_TO", 2)
    found = registry.QUERIES["keyword_search_default"](spark, "/root/testdata/sf0.001").orderBy("page_pos").collect()
    ids = [r["id"] for r in found]
    assert len(ids) > 2 and ids == sorted(ids)


def test_newest_blocks(spark):
    rows = spark.createDataFrame([("a", 10, 500), ("b", 20, 400), ("c", 30, 300), ("d", 30, 500)], "ip string, last_seen long, blocked_until_ms long")
    assert [r["ip"] for r in streaming.list_blocks(rows, 3).collect()] == ["c", "d", "b"]
    assert [r["ip"] for r in streaming.list_blocks(rows, 3, "blocked_until_ms").collect()] == ["a", "d", "b"]


def test_blocks_are_listed_by_their_end(spark):
    ends = [r["blocked_until_ms"] for r in registry.QUERIES["list_blocks"](spark, "/root/testdata/sf0.01").collect()]
    assert len(set(ends)) > 2 and ends == sorted(ends, reverse=True)
