"""Common contents, deep pages, shared keys and null keys, held against plain Python."""

import collections
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from shellac import streaming
from shellac.operators import audit, diff, overlay, search
from shellac.schema import LOG
from shellac.streaming import ranges
from test_jobs import NOW, catalogue, source


def diff_of(live, target):
    """(content, status, id, n) by the rule: the highest live ids stay, first copies of the target first."""
    ids, places = collections.defaultdict(list), collections.defaultdict(list)
    for i, t in enumerate(live, 1):
        ids[t].insert(0, i)
    for n, t in enumerate(target, 1):
        places[t].append(n)
    out = []
    for t in ids.keys() | places.keys():
        a, b = ids[t], places[t]
        k = min(len(a), len(b))
        out += [("unchanged", i, n) for i, n in zip(a[:k], b[:k], strict=True)] + [("delete", i, None) for i in a[k:]] + [("insert", None, n) for n in b[k:]]
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def common():
    rng = random.Random(1)
    mixed = lambda n, share: [("hot" if rng.random() < share else f"t{rng.randrange(n)}") for _ in range(n)]
    return mixed(3000, 0.4), mixed(2500, 0.5)


def test_diff_of_a_common_content(spark, common):
    live, target = common
    got = diff.multiset_diff(source(spark, [{"title": t} for t in live], "id"), source(spark, [{"title": t} for t in target]))
    assert sorted(repr((r["status"], r["id"], r["n"])) for r in got.collect()) == diff_of(live, target)


def test_copies_of_a_content_are_numbered_in_many_ranges(spark, common, monkeypatch):
    kept = []
    monkeypatch.setattr(diff, "stored", lambda df, name, f=diff.stored: kept.append(f(df, name)) or kept[-1])
    rows = source(spark, [{"title": t} for t in common[0]], "id").select(F.col("title").alias("hash"), "id", (F.col("id") % 7).alias("more"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = diff.numbered_copies(rows, "id").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    want, seen = {}, collections.Counter()
    for i, t in enumerate(common[0], 1):
        seen[t] += 1
        want[i] = (t, i % 7, seen[t])
    assert {r["id"]: (r["hash"], r["more"], r["rn"]) for r in got} == want
    sizes = [r["count"] for r in kept[0].groupBy("range").count().collect()]
    assert len(sizes) == 4 and max(sizes) <= 2 * statistics.median(sizes)
    assert kept[0].filter("hash = 'hot'").select("range").distinct().count() >= 2


def test_history_of_a_common_content(spark, common, monkeypatch):
    monkeypatch.setattr(diff, "COPIES", 100)
    live, target = (source(spark, [{"title": t} for t in side], order) for side, order in zip(common, ("id", "n"), strict=True))
    history = spark.createDataFrame([], "id long, created_at timestamp, inserted_count long, deleted_count long, result_count long, previous_count long, truncated boolean")
    changes = spark.createDataFrame([], "import_id long, op string, " + ", ".join(f"{f} string" for f in live.columns[1:]))
    for a, b, was in ((live, target, common[0]), (target.withColumnRenamed("n", "id"), live.withColumnRenamed("id", "n"), common[1])):
        d = diff.multiset_diff(a, b)
        _, made = diff.record_import(history, changes, d, a, b, NOW)
        before = diff.reconstruct_before(diff.apply_diff(a, b, d), made, 1)
        assert sorted(r["title"] for r in before.collect()) == sorted(was)


@pytest.mark.parametrize("down", [False, True])
def test_deep_pages(spark, down):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "a", "b", "é", "tie", f"v{rng.randrange(500):03}"]), rng.choice([None, 1, 2, rng.randrange(300)])) for i in rng.sample(range(10_000), 2300)]
    df = spark.createDataFrame(rows, "id long, name string, year int").repartition(5)
    for at, column in ((1, "name"), (2, "year")):
        some = [r for r in rows if r[at] is not None]
        some.sort(key=lambda r: r[0])
        some.sort(key=lambda r: r[at].encode() if at == 1 else r[at], reverse=down)
        want = [r[0] for r in some + sorted((r for r in rows if r[at] is None), key=lambda r: r[0])]
        for page in (1, 2, 9, 22, 23, 24):
            got = search.paged(df, [(column, down), ("id", False)], page, deep_from=0).orderBy("page_pos").collect()
            assert [r["id"] for r in got] == want[100 * page - 100 : 100 * page] and [r["page_pos"] for r in got] == list(range(100 * page - 99, 100 * page - 99 + len(got)))
        for page in (3, 23):
            got = search.keyed_page(df, [(column, down), ("id", False)], page, deep_from=0, most=60).collect()
            assert [r["id"] for r in got] == want[100 * page - 100 : 100 * page]


def test_ranges_get_small(spark):
    df = spark.range(50_000).withColumn("name", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")))
    test, skipped = search.rank_range(df, [("name", False), ("id", False)], 48_000, 50_000, most=500)
    inside = df.filter(test).count()
    assert 0 < inside <= 500 and skipped <= 48_000 < skipped + inside
    # rows that nothing tells apart are one range
    test, skipped = search.rank_range(df.withColumn("name", F.lit("x")), [("name", False)], 10, 50_000, most=500)
    assert skipped == 0 and df.withColumn("name", F.lit("x")).filter(test).count() == 50_000


def test_edits_of_rows_that_share_an_added_key(spark):
    cat = catalogue(spark, [{"matrix_number": "A", "title": " one "}, {"matrix_number": "A", "title": "two"}, {"matrix_number": "B"}])
    overrides = spark.createDataFrame([], "record_key string, field string, value string, base_value string, has_base boolean, record_label string, record_id long, editor_id long, editor_name string, updated_at timestamp")
    added = spark.createDataFrame([(1, "mx:a", '{"title": "old", "notes": "n"}', NOW)], "id long, record_key string, data string, updated_at timestamp")
    edits = [(1, "title", "first", 1), (2, "title", "second", 1), (1, "year", "1970", 2), (1, "title", "one", 0), (3, "producer", "x", 1), (3, "producer", "x", 2)]
    batch = spark.createDataFrame([(i, f, v, "cleo", s) for i, f, v, s in edits], "record_id long, field string, value string, editor_name string, seq long")
    got = overlay.apply_edits(cat, overrides, added, spark.createDataFrame([], LOG), batch, NOW)
    data = got["added"].select(F.from_json("data", "map<string,string>").alias("d")).first()["d"]
    assert data == {"title": "second", "notes": "n", "year": "1970"}
    assert sorted((r["id"], r["title"]) for r in got["cat"].filter("id < 3").collect()) == [(1, "first"), (2, "second")]
    # blanks around the stored value are no change: the edit to "one" is not logged
    assert sorted((r["record_id"], r["old_value"], r["new_value"]) for r in got["log"].filter("field = 'title'").collect()) == [(1, "one", "first"), (2, "two", "second")]
    assert [r["record_key"] for r in got["overrides"].collect()] == ["mx:b"]


@pytest.mark.parametrize("kind", ["long", "double", "string"])
def test_null_keys_are_one_key(spark, kind):
    rows = [(i, None if i % 2 else i % 4, i) for i in range(24)]
    events = spark.createDataFrame(rows, "event_id long, k long, ms long").withColumn("k", F.col("k").cast(kind))
    got = {r["event_id"]: (r["count"], r["allowed"]) for r in streaming.replay(events, streaming.request_limiter(3), "k", "event_id").collect()}
    assert [got[i][0] for i in range(1, 24, 2)] == list(range(1, 13)) and [got[i][0] for i in range(0, 24, 4)] == list(range(1, 7))
    assert [got[i][1] for i in (5, 7)] == [True, False]


@pytest.mark.parametrize("window", [40, 1000, 10**6])
def test_a_hot_key_is_replayed_in_ranges(spark, monkeypatch, window):
    """Half of all events have one key, a sixth none; windows within a range, over some and over all of them."""
    rng = random.Random(window)
    rows = [(i, rng.choice([7, 7, 7, None, rng.randrange(100, 140), 9]), rng.choice([i, i // 9 * 9, 3 * i])) for i in range(4000)]
    events = spark.createDataFrame(rows, "event_id long, k long, ms long").withColumn("more", F.lit("x"))
    kept = []
    monkeypatch.setattr(ranges, "stored", lambda df, name, f=ranges.stored: kept.append((name, f(df, name))) or kept[-1][1])
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {tuple(r) for r in ranges.replay_limiter(events, "k", "event_id", 3, window).collect()}
        want = {tuple(r) for r in streaming.replay(events, streaming.request_limiter(3, window), "k", "event_id").collect()}
        assert ranges.replay_limiter(events.limit(0), "k", "event_id", 3, window).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == want and len(got) == 4000
    sizes = [r["count"] for r in kept[0][1].groupBy("_range").count().collect()]
    assert kept[0][1].filter("k = 7").select("_range").distinct().count() >= 6 and max(sizes) <= 2 * statistics.median(sizes)


def test_steps_put_together():
    rng = np.random.default_rng(4)
    for window in (3, 30, 400):
        ms = np.sort(rng.integers(0, 300, 200))
        whole = ranges.steps(ms, window, 0)
        for cut in (1, 50, 199):
            assert [x.tolist() for x in ranges.composed(ranges.steps(ms[:cut], window, 0), ranges.steps(ms[cut:], window, cut))] == [x.tolist() for x in whole]


def test_grid_join(spark):
    rng = random.Random(6)
    sides = [[(i, rng.choice(["hot", "hot", "warm", f"k{rng.randrange(40)}"]), rng.choice(["x", None, "y"])) for i in range(n)] for n in (400, 300)]
    a, b = (spark.createDataFrame(rows, f"{name} long, k string, v{name} string") for rows, name in zip(sides, ("a", "b"), strict=True))
    want = sorted((i, j) for i, k, _ in sides[0] for j, m, _ in sides[1] if k == m)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (20, 1000):
            met = audit.grid_join(a, b, ["k"], "a", "b", most)
            assert sorted((r["a"], r["b"]) for r in met.select("a", "b").collect()) == want and met.columns == ["k", "a", "va", "b", "vb"]
        sizes = [r["count"] for r in audit.grid_join(a, b, ["k"], "a", "b", 20).groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 4 and max(sizes) <= 2 * statistics.median(sizes)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_releases_with_odd_numbers(spark):
    """A row whose own number doesn't begin with its base has siblings, but is none."""
    row = lambda number, title, b=None: {"label_number": number, "title": title, "artist": "A", "label": "L", "format": "12", "year": "1970", "b_side_title": b, "b_side_artist": b and "A"}
    cat = catalogue(spark, [row("GR 1-A", "one", "two"), row("GR 1-A2", "two"), row("GR  1-B", "three", "ONE"), row("GR 2-A2", "alone"), *(row(f"GR 3-A{i}", f"s{i}") for i in range(7))])
    assert sorted(tuple(r) for r in audit.release_siblings(cat).collect()) == [(1, 2), (2, 1), (3, 1), (3, 2)]
    got = sorted(tuple(r) for r in audit.release_tracks(audit.release_groups(cat, tracks=True)).select("anchor_id", "position", "title", "record_id", "here").collect())
    assert got == [(1, 1, "one", 1, True), (1, 2, "two", 2, True), (2, 1, "one", 1, False), (2, 2, "two", 2, True), (3, 1, "one", 1, True), (3, 2, "two", 2, False), (3, 3, "three", 3, True)]
