"""Changes of a stored catalogue equal those of a whole table, and write the blocks they touch alone."""

import datetime

import pytest
from pyspark.sql import functions as F

from shellac.functions import derived_columns
from shellac.operators import overlay
from shellac.operators.blocks import Blocks
from shellac.schema import ADDED, LOG, OVERRIDES, TOMBSTONES
from shellac.storage import stored
from test_jobs import source

NOW = datetime.datetime(2024, 6, 1)


@pytest.fixture(scope="module")
def cat(spark):
    rows = [{"artist": f"A{i % 7}", "title": f"T{i}", "matrix_number": f"M{i // 2}", "country": "Jamaca" if i in (33, 71) else "Jamaica"} for i in range(100)]
    return stored(source(spark, rows, "id").withColumns(derived_columns()), "cat")


def sides(spark):
    return {n: spark.createDataFrame([], kind) for n, kind in (("overrides", OVERRIDES), ("added", ADDED), ("tombstones", TOMBSTONES), ("log", LOG))}


def rows_of(df, *columns):
    return sorted(repr(tuple(r)) for r in df.select(*(columns or sorted(df.columns))).collect())


def folders(blocks):
    return {r["block"]: r["folder"] for r in blocks.manifest.collect()}


def edits(spark, *rows):
    return spark.createDataFrame([(i, f, v, "cleo", n) for n, (i, f, v) in enumerate(rows)], "record_id long, field string, value string, editor_name string, seq long")


def same(made, tables, want):
    assert rows_of(made.read()) == rows_of(want.pop("cat"))
    assert {n: rows_of(t) for n, t in tables.items()} == {n: rows_of(t) for n, t in want.items()}


def test_a_series_of_changes(spark, cat, tmp_path):
    s = sides(spark)
    one = Blocks.publish(cat, str(tmp_path), 10)
    assert rows_of(one.read()) == rows_of(cat) and len(folders(one)) == 11
    batch = edits(spark, (15, "title", "New"), (15, "title", " Newer "), (62, "country", ""), (17, "title", "T16"), (5000, "title", "nobody"), (None, "title", "x"))
    two, tables = one.apply_edits(s["overrides"], s["added"], s["log"], batch, NOW)
    whole = overlay.apply_edits(cat, s["overrides"], s["added"], s["log"], batch, NOW)
    now, o, log = stored(whole["cat"], "cat"), stored(whole["overrides"], "o"), stored(whole["log"], "log")
    same(two, tables, whole | {"cat": now})
    assert {b for b in folders(one) if folders(one)[b] != folders(two)[b]} == {1, 6}

    ids = spark.createDataFrame([(i,) for i in (*range(40, 50), 62, 99, 7000)], "id long")
    three, tables = two.delete_records(o, s["added"], s["tombstones"], log, ids, "ann", NOW)
    want = overlay.delete_records(now, o, s["added"], s["tombstones"], log, ids, "ann", NOW)
    now = stored(want["cat"], "cat")
    same(three, tables, want | {"cat": now})
    assert 4 not in folders(three) and {b for b in folders(three) if folders(two)[b] != folders(three)[b]} == {6, 9}

    new = spark.createDataFrame([(k, f"N{k}") for k in range(14)], "seq long, title string")
    four, tables = three.create_records(s["added"], log, new, "dora", NOW)
    want = overlay.create_records(now, s["added"], log, new, "dora", NOW)
    now = stored(want["cat"], "cat")
    same(four, tables, want | {"cat": now})
    assert {b for b, f in folders(four).items() if folders(three).get(b) != f} == {10, 11}

    which = o.filter("field = 'title'").select("record_key", "field")
    five, tables = four.remove_overrides(o, log, which, "ann", NOW)
    want = overlay.remove_overrides(now, o, log, which, "ann", NOW)
    now = stored(want["cat"], "cat")
    same(five, tables, want | {"cat": now})
    assert {b for b in folders(five) if folders(four)[b] != folders(five)[b]} == {1}

    fixes = spark.createDataFrame([("country", "Jamaca", "Jamaica")], "field string, current string, suggested string")
    six, tables = five.apply_category_fix(o, s["added"], log, fixes, "ann", NOW)
    same(six, tables, overlay.apply_category_fix(now, o, s["added"], log, fixes, "ann", NOW))
    assert {b for b in folders(six) if folders(five)[b] != folders(six)[b]} == {3, 7}
    assert rows_of(one.read()) == rows_of(cat)  # an older generation is as it was


def test_nothing_touched_and_empty_catalogues(spark, cat, tmp_path):
    s = sides(spark)
    one = Blocks.publish(cat.withColumn("block", F.lit("x")), str(tmp_path / "a"), 10)
    two, tables = one.apply_edits(s["overrides"], s["added"], s["log"], edits(spark, (-5, "title", "x")), NOW)
    assert folders(two) == folders(one) and tables["log"].count() == 0 and two.read().filter("block = 'x'").count() == 100
    none = Blocks.publish(cat.limit(0), str(tmp_path / "b"), 10)
    assert none.read().count() == 0 and none.read().schema.names == cat.schema.names
    made, _ = none.create_records(s["added"], s["log"], spark.createDataFrame([(1, "a"), (2, "b")], "seq long, title string"), "dora", NOW)
    assert rows_of(made.read(), "id", "title") == ["(1, 'a')", "(2, 'b')"]
