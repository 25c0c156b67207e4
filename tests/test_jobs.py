"""Overlay, diff, audits, guards and files on small rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from shellac import sources, streaming
from shellac.functions import derived_columns, record_key
from shellac.operators import audit, diff, facets, overlay
from shellac.schema import SOURCE_FIELDS

NOW = datetime.datetime(2024, 1, 1)


def source(spark, rows, order="n"):
    return spark.createDataFrame([tuple([i, *(r.get(f) for f in SOURCE_FIELDS)]) for i, r in enumerate(rows, 1)], f"{order} long, " + ", ".join(f"{f} string" for f in SOURCE_FIELDS))


def catalogue(spark, rows):
    return source(spark, rows, "id").withColumns(derived_columns())


def test_merge_cases(spark):
    up = source(spark, [{"matrix_number": f"M{i}", "producer": p} for i, p in enumerate(["a", "a", "a", None, "new", "a", "a"])])
    kind = "record_key string, field string, value string, base_value string, has_base boolean"
    edits = spark.createDataFrame([("mx:m0", "producer", "X", None, False), ("mx:m1", "producer", "X", "a", True), ("mx:m2", "producer", "X", "b", True), ("mx:m3", "producer", "X", None, True),
                                   ("mx:m4", "producer", "X", "old", True), ("mx:m5", "producer", None, "a", True), ("mx:m6", "pressing", "X", None, False)], kind)
    got = {r["matrix_number"]: r["producer"] for r in overlay.merge_overrides(up, edits).collect()}
    assert got == {"M0": "X", "M1": "X", "M2": "a", "M3": "X", "M4": "new", "M5": "a", "M6": "a"}


def test_added_rows_and_tombstones(spark):
    up = source(spark, [{"matrix_number": "A"}, {"matrix_number": "B"}])
    dead = spark.createDataFrame([("mx:b",)], "record_key string")
    added = spark.createDataFrame([(1, "mx:a", "{}"), (2, "mx:b", '{"title": " T ", "label": " "}'), (3, "mx:c", "not json")], "id long, record_key string, data string")
    rows = overlay.append_added(overlay.drop_tombstones(up, dead), added).collect()
    assert sorted((r["record_key"], r["title"]) for r in rows) == [("mx:a", None), ("mx:b", "T"), ("mx:c", None)]


def test_multiset_diff_and_history(spark):
    a, b, c = ({"title": x} for x in "abc")
    live, target = source(spark, [a, a, b, b], "id"), source(spark, [a, b, b, b, c])
    d = diff.multiset_diff(live, target)
    assert sorted((r["status"], r["id"] or 0) for r in d.collect()) == [("delete", 1), ("insert", 0), ("insert", 0), ("unchanged", 2), ("unchanged", 3), ("unchanged", 4)]
    after = diff.apply_diff(live, target, d)
    assert sorted((r["id"], r["title"]) for r in after.collect()) == [(2, "a"), (3, "b"), (4, "b"), (5, "b"), (6, "c")]
    history = spark.createDataFrame([], "id long, created_at timestamp, inserted_count long, deleted_count long, result_count long, previous_count long, truncated boolean")
    changes = spark.createDataFrame([], "import_id long, op string, " + ", ".join(f"{f} string" for f in SOURCE_FIELDS))
    history, changes = diff.record_import(history, changes, d, live, target, NOW)
    assert diff.can_reconstruct(history, 1).first()["can"] and not diff.can_reconstruct(history, 2).first()["can"]
    assert sorted(r["title"] for r in diff.reconstruct_before(after, changes, 1).collect()) == ["a", "a", "b", "b"]
    assert diff.multiset_diff(live, live.withColumnRenamed("id", "n")).filter("status <> 'unchanged'").count() == 0
    assert diff.multiset_diff(live.limit(0), target).filter("status = 'insert'").count() == 5


def test_truncated_history(spark, monkeypatch):
    monkeypatch.setattr(diff, "KEPT_PAYLOAD", 2)
    live, target = source(spark, [{"title": x} for x in "aabb"], "id"), source(spark, [{"title": x} for x in "abbbc"])
    d = diff.multiset_diff(live, target)
    after = diff.apply_diff(live, target, d)
    history = spark.createDataFrame([], "id long, created_at timestamp, inserted_count long, deleted_count long, result_count long, previous_count long, truncated boolean")
    changes = spark.createDataFrame([], "import_id long, op string, " + ", ".join(f"{f} string" for f in SOURCE_FIELDS))
    cut, kept = diff.record_import(history, changes, d, live, target, NOW)
    assert cut.first()["truncated"] and not diff.can_reconstruct(cut, 1).first()["can"]
    for f in (lambda: diff.net_reversal(kept, 1), lambda: diff.reconstruct_before(after, kept, 1)):
        with pytest.raises(ValueError):
            f()
    assert diff.net_reversal(kept, 2).count() == 0
    entries, rows = diff.record_import(history, changes, d, live, target, NOW, whole=True)
    assert diff.can_reconstruct(entries, 1).first()["can"]
    assert sorted(r["title"] for r in diff.reconstruct_before(after, rows, 1).collect()) == ["a", "a", "b", "b"]


def side(n, **more):
    return {"label_number": n, "label": "L", "year": "1970", "format": "12", "artist": "a", "title": f"t {n}", "b_side_title": "x", **more}


def test_release_siblings(spark):
    got = lambda rows: {(r["id"], r["sibling_id"]) for r in audit.release_siblings(catalogue(spark, rows)).collect()}
    assert got([side("GR 266-A"), side("GR 266-B")]) == set()
    assert got([side("GR 266-A"), side("GR 266-B2"), side("GR 2660-A2")]) == {(1, 2), (2, 1)}
    assert got([side("GR 266-A"), side("GR 266-B2", year="1971")]) == set()
    assert got([side("GR 266-A2")] * 7) == set()


def test_release_tracks(spark):
    pair = lambda a, b: {"label_number": f"GR 266-{a}", "b_side_label_number": f"GR 266-{b}", "label": "L", "artist": "x", "title": f"song {a}", "b_side_artist": "x", "b_side_title": f"song {b}"}
    cat = catalogue(spark, [pair("A", "A2"), pair("A2", "A"), pair("B", "B2"), pair("B2", "B")])
    rows = audit.release_tracks(audit.release_groups(cat, tracks=True)).filter("anchor_id = 1").orderBy("position").collect()
    assert [(r["title"], r["here"]) for r in rows] == [("song A", True), ("song A2", True), ("song B", False), ("song B2", False)]


def test_matrix_mismatches(spark):
    own = {"title": "Song", "artist": "a", "label": "L", "country": "JA", "matrix_number": "DSR 1234 A"}
    stub = {"title": "Other", "artist": "a", "b_side_title": "song ", "b_side_artist": "A", "label": "l", "country": "JA", "b_side_matrix_number": "DSR 1234"}
    rows = audit.matrix_mismatches(catalogue(spark, [own, stub, {**stub, "country": "UK"}, {**stub, "b_side_matrix_number": None}])).collect()
    assert [(r["own_id"], r["stub_id"], r["shared"]) for r in rows] == [(1, 2, "DSR 1234")]


def test_format_variants(spark):
    values = ["Dancehall", "Dancehall", "dancehall", "R&B from USA", "R & B from USA", "Pop from UK", "Pop from USA", "12 EP?", "12 (EP)?"]
    rows = audit.format_variants(catalogue(spark, [{"genre": v} for v in values])).collect()
    assert sorted((r["current"], r["suggested"]) for r in rows) == [("R&B from USA", "R & B from USA"), ("dancehall", "Dancehall")]


def test_facets(spark):
    cat = catalogue(spark, [{"artist": "Bob"}, {"artist": "BOB"}, {"artist": "Dubious Entry"}, {"artist": None}, {"artist": "9 Men"}])
    assert {(r["value"], r["label"], r["n"]) for r in facets.facet_index(cat, "artists").collect()} == {("bob", "Bob", 2), ("9 men", "9 Men", 1)}
    assert [r["value"] for r in facets.facet_index(cat, "artists", "#").collect()] == ["9 men"]
    assert {r["value"] for r in facets.facet_unknown(cat, "artists", "b").collect()} == {"bob"}
    assert facets.facet_unknown(cat, "artists").filter("value = '__unknown__'").first()["n"] == 1


def events(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, ip string, ms long, weight int, free boolean")


def test_crawl_guard(spark):
    m = streaming.MINUTE
    rows = [("a", i, 1, False) for i in range(900)] + [("a", 5 * m, 1, False), ("b", 0, 1, True), ("c", 0, 399, False), ("c", 1, 1, False)]
    for k, start in enumerate((20 * m, 120 * m, 600 * m)):
        rows.append(("d", start, 900, False))
    rows += [("e", 0, 900, False), ("e", 16 * m, 900, False), ("e", 80 * m, 900, False), ("e", 500 * m, 900, False)]
    got = {r["event_id"]: r for r in streaming.replay(events(spark, rows), streaming.crawl_guard(), "ip", "event_id").collect()}
    assert [got[i]["action"] for i in (398, 399, 899, 900, 901, 902, 903)] == ["allow", "warn", "block", "block", "allow", "allow", "warn"]
    assert got[900]["retry_minutes"] == 11
    assert [got[i]["retry_minutes"] for i in range(907, 911)] == [15, 60, 360, 360]


def test_limiter_and_lockout(spark):
    rows = [("a", i, 1, False) for i in range(151)] + [("a", 60_000, 1, False), ("a", 60_001, 1, False)]
    got = [r["allowed"] for r in streaming.replay(events(spark, rows), streaming.request_limiter(), "ip", "event_id").orderBy("event_id").collect()]
    assert got[:150] == [True] * 150 and got[150:] == [False, False, True]
    m = streaming.MINUTE
    tries = [("x", i, False) for i in range(5)] + [("x", 10, False), ("x", 15 * m + 5, True), ("x", 15 * m + 6, False), ("y", 0, False), ("y", 1, True), ("y", 2, False)]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(tries)], "attempt_id long, key string, ms long, success boolean")
    got = [(r["failures"], r["was_locked"]) for r in streaming.replay(df, streaming.login_lockout(), "key", "attempt_id").orderBy("attempt_id").collect()]
    assert got == [(1, False), (2, False), (3, False), (4, False), (5, False), (6, True), (0, False), (1, False), (1, False), (0, False), (1, False)]


def by_hand(batches, guard, key, order):
    """Verdicts of the steps themselves over micro-batches, each sorted by time; late events count at the key's last time."""
    state, last, out = {}, {}, {}
    for rows in batches:
        for e in sorted(rows, key=lambda e: (e["ms"], e[order])):
            k = e[key]
            last[k] = max(last.get(k, 0), e["ms"])
            state[k], verdict = guard.step(state.get(k, guard.start), e | {"ms": last[k]})
            out[(e[order], k)] = tuple(verdict)
    return out


M, BASE = streaming.MINUTE, 1_700_000_000_000
GUARDS = {
    "limiter": (streaming.request_limiter(3), lambda i: {"ip": f"k{i % 3}", "ms": BASE + i * 7_000, "weight": 1, "free": False, "success": False}),
    "crawl": (streaming.crawl_guard(warn=4, block=6), lambda i: {"ip": f"k{i % 3}", "ms": BASE + i * 40_000 + (i // 30) * 30 * M, "weight": 1 + i % 3, "free": i % 17 == 0, "success": False}),
    "lockout": (streaming.login_lockout(), lambda i: {"ip": f"k{i % 3}", "ms": BASE + i * 50_000, "weight": 1, "free": False, "success": i % 23 == 22}),
}


KIND = "event_id long, ip string, ms long, weight int, free boolean, success boolean"


def streamed(spark, folder, cut, guard, name, **how):
    """Verdicts of a stream whose micro-batches are the given lists of events, and its query."""
    import os

    (folder / "in").mkdir(parents=True)
    for k, part in enumerate(cut):
        df = spark.createDataFrame([tuple(r[c.split()[0]] for c in KIND.split(", ")) for r in part], KIND).withColumn("ts", F.timestamp_millis("ms"))
        df.coalesce(1).write.parquet(str(folder / f"part{k}"))
        made = next(p for p in (folder / f"part{k}").iterdir() if p.suffix == ".parquet")
        made.rename(folder / "in" / f"{k}.parquet")
        os.utime(folder / "in" / f"{k}.parquet", (1_700_000_000 + 100 * k,) * 2)
    read = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    for k, v in streaming.STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        query = streaming.stream(read, guard, "ip", "event_id", **how).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(300)
    finally:
        for k in streaming.STATE_STORE:
            spark.conf.unset(k)
    return {(r["event_id"], r["ip"]): tuple(r[n] for n in guard.names) for r in spark.table(name).collect()}, query


def replayed(spark, rows, guard):
    once = spark.createDataFrame([tuple(r[c.split()[0]] for c in KIND.split(", ")) for r in rows], KIND)
    return {(r["event_id"], r["ip"]): tuple(r[n] for n in guard.names) for r in streaming.replay(once, guard, "ip", "event_id").collect()}


@pytest.mark.parametrize("name", GUARDS)
def test_stream_equals_replay(spark, tmp_path, name):
    """Several micro-batches with late events, and one so late that windows before it were evicted: strikes stay."""
    guard, make = GUARDS[name]
    rows = [{"event_id": i} | make(i) for i in range(90)]
    cut = [rows[:30], rows[33:60], [*rows[30:33], *rows[60:]]]  # three come late, within the delay
    end = rows[-1]["ms"] + 600 * M
    cut += [[{"event_id": 100} | make(0) | {"ip": "other", "ms": end}], [{"event_id": 101} | make(1) | {"ip": "other", "ms": end + 1}], [{"event_id": 110 + i} | make(i) | {"ms": end + M + i, "weight": 6} for i in range(9)]]
    got, query = streamed(spark, tmp_path, cut, guard, name)
    hand = by_hand(cut, guard, "ip", "event_id")
    if name == "lockout":  # a lock that is over reads 0 once its state has been evicted
        hand = {k: (*v[:2], v[2] if v[2] > end or k[0] < 110 else 0) for k, v in hand.items()}
    assert got == hand and len(got) == 101
    removed = sum(p["stateOperators"][0]["numRowsRemoved"] for p in query.recentProgress if p["stateOperators"])
    assert removed >= 3 if name != "crawl" else any(v[2] > 1 for (i, _), v in got.items() if i >= 110)
    assert replayed(spark, rows, guard) == by_hand([rows], guard, "ip", "event_id")


@pytest.mark.parametrize("name", GUARDS)
def test_stream_in_order(spark, tmp_path, name):
    """Late events, equal times, null keys and windows that lapse between: in order, a stream is a replay."""
    guard, make = GUARDS[name]
    rows = [{"event_id": i} | make(i) for i in range(90)]
    for r in rows[20:60:5]:
        r["ms"] = rows[20]["ms"]
    for r in rows[::7]:
        r["ip"] = None
    end = rows[-1]["ms"] + 300 * M
    rows += [{"event_id": 90 + i} | make(i) | {"ms": end + i * M} for i in range(30)]
    cut = [rows[1:40:2], rows[:40:2], rows[60:90], rows[40:60], rows[110:], rows[90:110]]
    closing = [{"event_id": 1000 + i} | make(0) | {"ip": "closing", "ms": end + (700 + 100 * i) * M} for i in range(2)]
    got, _ = streamed(spark, tmp_path, [*cut, *([c] for c in closing)], guard, f"ordered_{name}", in_order=True, slice_ms=20_000)
    want, ms = replayed(spark, rows, guard), {r["event_id"]: r["ms"] for r in rows}
    if name == "lockout":  # as above
        got, want = ({k: (*v[:2], v[2] if v[2] > ms[k[0]] else 0) for k, v in x.items() if k[0] < 1000} for x in (got, want))
    assert {k: v for k, v in got.items() if k[0] < 1000} == want and len(want) == 120


def test_stream_walks_a_key_in_pieces(spark, tmp_path):
    """No frame is larger than an Arrow batch, however many events of a key one micro-batch holds."""
    guard = streaming.request_limiter(10**6, 10**9)
    rows = [{"event_id": i, "ip": "hot", "ms": BASE + i, "weight": 1, "free": False, "success": False} for i in range(1000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    walk = guard.walk
    guard.walk = lambda state, ms: (walk(state, ms)[0], [[len(ms)] * len(ms), [True] * len(ms)])
    try:
        got, _ = streamed(spark, tmp_path, [rows], guard, "pieces")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    most = {v[0] for v in got.values()}
    assert len(got) == 1000 and max(most) <= 64


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbfArtist,Credit\nAn\xc3\xa9,\"two\nlines\"\n,\n short\n")
    (tmp_path / "b.csv").write_bytes("Artist\nAné\n".encode("cp1252"))
    kinds = {r["file"].rsplit("/", 1)[1]: r["encoding"] for r in sources.detect_encoding(spark, str(tmp_path / "*.csv")).collect()}
    assert kinds == {"a.csv": "UTF-8", "b.csv": "windows-1252"}
    rows = sources.read_catalogue_csv(spark, str(tmp_path / "a.csv")).orderBy("n").collect()
    assert [(r["n"], r["artist"], r["artist_credit"]) for r in rows] == [(1, "Ané", "two\nlines"), (2, "short", None)]
    assert sources.read_catalogue_csv(spark, str(tmp_path / "b.csv"), "windows-1252").first()["artist"] == "Ané"


def test_generations(spark, tmp_path):
    gens = sources.Generations(spark, f"file://{tmp_path}/g")
    with pytest.raises(ValueError):
        gens.restore_previous("x")
    gens.publish(spark.range(3), "1")
    gens.publish(spark.range(5), "2")
    for n in (3, 5):
        gens.restore_previous("3")
        assert gens.read().count() == n
    assert gens.status().first().asDict() == {"has_live": True, "n_rows": 5, "updated_at": "3", "has_previous": True}
    # another publisher has taken the next number and is not done yet
    other = sources.Generations(spark, f"file://{tmp_path}/g")
    taken = other._claim(3)
    assert (taken, gens.publish(spark.range(7), "4"), gens.publish(spark.range(8), "5")) == (3, 4, 5)
    assert gens.read().count() == 8 and gens.read("previous").count() == 7
    assert sources.row_count_gate(spark.range(1), spark.range(3)).first()["warn"]


def test_dense_numbers_and_sitemap(spark):
    ids = spark.range(0, 1000, 3).select(F.col("id"))
    assert [r["n"] for r in diff.dense_numbers(ids, "id", "n").orderBy("id").collect()] == list(range(1, 335))
    chunks = {r["chunk"]: r["n"] for r in sources.sitemap_index(sources.sitemap_chunks(ids, 100)).collect()}
    assert chunks == {0: 100 + len(sources.STATIC_PAGES), 1: 100, 2: 100, 3: 34}
    assert sources.sitemap_index(sources.sitemap_chunks(ids.limit(0), 100)).count() == 1


def test_page_parsing():
    from shellac.operators import search

    pages = {"1a2": 1, "1e3": 1, "abc3": 1, "5-3": 5, " 7": 7, "-2": 1, "": 1, None: 1, "3.9": 3, 4: 4, "999999": 10_000}
    assert {p: search.parse_page(p) for p in pages} == pages


def test_phrases_with_marks(spark):
    from shellac.operators import search

    cat = catalogue(spark, [{"title": t} for t in ("D\u00e9j\u00e0 Vu", "De\u0301ja\u0300 vu", "deja vuelta", "vu deja", "Ti\u1ebfng Vi\u1ec7t", "\u0386\u03bb\u03c6\u03b1")])
    ids = lambda q: sorted(r["id"] for r in cat.filter(search.phrase_match(q)).collect())
    assert ids("d\u00e9ja-vu") == [1, 2, 3] and ids("tieng vie") == [5] and ids("\u03b1\u03bb\u03c6\u03b1") == [6]
    assert sorted(r["id"] for r in search.keyword_search(cat, "de\u0301ja vu").collect()) == [1, 2, 3]


def test_record_key_default(spark):
    rows = source(spark, [{"matrix_number": " Mx  1 "}, {"label_number": "L1", "artist": "A", "title": "T"}, {}])
    assert [r["k"] for r in rows.select(record_key().alias("k")).collect()] == ["mx:mx 1", "lk:l1|a|t", "lk:||"]
