"""Human corrections over the catalogue: three-way merge and edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import derived_columns, null_if_blank, record_key, record_label
from ..schema import EDITABLE_FIELDS, SOURCE_FIELDS
from ..storage import sized
from .diff import dense_numbers

def merge_overrides(upload: DataFrame, overrides: DataFrame) -> DataFrame:
    """The upload with its corrections; ``record_key`` is the key of the row before them.

    A correction wins without a known base, or while the upload still says what
    it said then; else the upload has moved on and wins.  Corrections to nothing
    and of other fields are passed over.  Rows that share a key are all
    corrected.
    """
    keyed = upload if "record_key" in upload.columns else upload.withColumn("record_key", record_key())
    valid = overrides.filter(F.col("value").isNotNull() & F.col("field").isin(EDITABLE_FIELDS))
    edit = F.struct("value", "base_value", "has_base")
    per_key = valid.groupBy("record_key").agg(F.map_from_entries(F.collect_list(F.struct("field", edit.alias("e")))).alias("_edits"))
    joined = keyed.join(sized(per_key), "record_key", "left")

    def merged(f: str):
        e = F.col("_edits")[f]
        wins = e.isNotNull() & (~F.coalesce(e["has_base"], F.lit(False)) | null_if_blank(f).eqNullSafe(e["base_value"]))
        return F.when(wins, e["value"]).otherwise(F.col(f))

    return joined.withColumns({f: merged(f) for f in EDITABLE_FIELDS}).drop("_edits")


def drop_tombstones(upload: DataFrame, tombstones: DataFrame) -> DataFrame:
    keyed = upload if "record_key" in upload.columns else upload.withColumn("record_key", record_key())
    return keyed.join(sized(tombstones.select("record_key").distinct()), "record_key", "left_anti")


def append_added(kept: DataFrame, added: DataFrame) -> DataFrame:
    """The rows that were kept and the added rows whose key none of them has.

    ``data`` is a JSON object; one that can't be read counts as empty.  Only the
    keys that the few added rows ask about are taken from the large side.
    """
    keys = sized(added.select("record_key").distinct())
    met = kept.select("record_key").join(keys, "record_key", "left_semi").distinct()
    fresh = added.join(met, "record_key", "left_anti")
    data = F.coalesce(F.from_json("data", "map<string,string>"), F.create_map().cast("map<string,string>"))
    rows = fresh.withColumn("_data", data)
    values = [null_if_blank(F.col("_data")[f]).alias(f) if f in EDITABLE_FIELDS else F.lit(None).cast("string").alias(f) for f in SOURCE_FIELDS]
    rest = [F.lit(None).cast(kept.schema[c].dataType).alias(c) for c in kept.columns if c not in SOURCE_FIELDS and c != "record_key"]
    return kept.unionByName(rows.select("record_key", *values, *rest).select(*kept.columns))


def target_catalogue(upload: DataFrame, overrides: DataFrame, tombstones: DataFrame, added: DataFrame) -> DataFrame:
    """The catalogue that an upload should become: tombstones, corrections, added rows, derived columns.

    The key stays that of the row before its corrections.
    """
    kept = merge_overrides(drop_tombstones(upload, tombstones), overrides)
    return append_added(kept, added).withColumns({k: v for k, v in derived_columns().items() if k != "record_key"})


def apply_edits(cat: DataFrame, overrides: DataFrame, added: DataFrame, log: DataFrame, batch: DataFrame, now) -> dict[str, DataFrame]:
    """Apply a batch of edits (record_id, field, value, editor_name, seq): new ``cat``, ``overrides``, ``added``, ``log``.

    Blank values are null and blanks around a value don't count, neither in the
    batch nor in the stored row; edits of unknown rows or fields, and those that
    change nothing, are dropped.  Edits of one cell follow each other by ``seq``.
    A row's key stays that before the edit; an override keeps the base of its
    first edit.  Edits of an added row go into its data instead.  Where several
    rows share a key, that of the highest id speaks for each field.
    """
    edits = batch.filter(F.col("field").isin(EDITABLE_FIELDS)).withColumn("value", null_if_blank("value"))
    cells = F.map_from_arrays(F.array(*map(F.lit, EDITABLE_FIELDS)), F.array(*map(null_if_blank, EDITABLE_FIELDS)))
    ids = sized(edits.select(F.col("record_id").alias("id")).distinct())
    touched = cat.join(ids, "id", "left_semi").select(F.col("id").alias("record_id"), F.coalesce("record_key", record_key()).alias("record_key"), record_label().alias("record_label"), cells.alias("_row"))
    cell = Window.partitionBy("record_id", "field").orderBy("seq")
    chained = edits.join(touched, "record_id").withColumn("first_old", F.element_at("_row", F.col("field")))
    chained = chained.withColumn("old_value", F.when(F.row_number().over(cell) == 1, F.col("first_old")).otherwise(F.lag("value").over(cell)))
    changed = chained.filter(~F.col("old_value").eqNullSafe(F.col("value")))
    last = changed.groupBy("record_id", "record_key", "field").agg(
        F.max_by("value", "seq").alias("value"), F.min_by("old_value", "seq").alias("old"), F.max_by("editor_name", "seq").alias("editor_name"), F.first("record_label").alias("record_label"))
    per_row = last.groupBy("record_id", "record_key").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("value").alias("v")))).alias("_new"))
    side = sized(per_row.select(F.col("record_id").alias("id"), F.col("record_key").alias("_pinned"), "_new"))
    joined = cat.join(side, "id", "left")
    edited = joined.withColumns({f: F.when(F.col("_new")[f].isNotNull(), F.col("_new")[f]["value"]).otherwise(F.col(f)) for f in EDITABLE_FIELDS})
    again = {k: v for k, v in derived_columns().items() if k != "record_key"}
    new_cat = edited.withColumns(again).withColumn("record_key", F.coalesce("_pinned", "record_key")).select(*cat.columns)

    own = added.select("record_key").distinct()
    to_rows, to_overrides = last.join(own, "record_key", "left_semi"), last.join(own, "record_key", "left_anti")
    # several rows may share a key: of those the highest id speaks
    fresh = to_overrides.groupBy("record_key", "field").agg(
        F.max_by("value", "record_id").alias("value"), F.max_by("old", "record_id").alias("base_value"), F.max_by("record_label", "record_id").alias("record_label"),
        F.max("record_id").alias("record_id"), F.max_by("editor_name", "record_id").alias("editor_name"))
    a, b = overrides.alias("a"), fresh.alias("b")
    both = a.join(b, ["record_key", "field"], "full_outer")
    is_new, was = F.col("b.record_id").isNotNull(), F.col("a.has_base").isNotNull()
    new_overrides = both.select(
        "record_key", "field", F.when(is_new, F.col("b.value")).otherwise(F.col("a.value")).alias("value"),
        F.when(was, F.col("a.base_value")).otherwise(F.col("b.base_value")).alias("base_value"), F.when(was, F.col("a.has_base")).otherwise(F.lit(True)).alias("has_base"),
        F.coalesce("b.record_label", "a.record_label").alias("record_label"), F.coalesce("b.record_id", "a.record_id").alias("record_id"), F.when(is_new, F.lit(None).cast("long")).otherwise(F.col("a.editor_id")).alias("editor_id"),
        F.coalesce("b.editor_name", "a.editor_name").alias("editor_name"), F.when(is_new, F.lit(now).cast("timestamp")).otherwise(F.col("a.updated_at")).alias("updated_at"))

    per_cell = to_rows.groupBy("record_key", "field").agg(F.max_by(F.struct("value"), "record_id").alias("v"))
    per_key = per_cell.groupBy("record_key").agg(F.map_from_entries(F.collect_list(F.struct("field", "v"))).alias("_new"))
    old = F.coalesce(F.from_json("data", "map<string,string>"), F.create_map().cast("map<string,string>"))
    written_back = F.to_json(F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys("_new"), k)), F.transform_values("_new", lambda k, v: v["value"])), {"ignoreNullFields": "false"})
    new_added = added.join(per_key, "record_key", "left").withColumns({
        "data": F.when(F.col("_new").isNotNull(), written_back).otherwise(F.col("data")), "updated_at": F.when(F.col("_new").isNotNull(), F.lit(now).cast("timestamp")).otherwise(F.col("updated_at"))}).select(*added.columns)
    return {"cat": new_cat, "overrides": new_overrides, "added": new_added, "log": log.unionByName(_logged(changed, "modified", now, log), allowMissingColumns=True)}


def _logged(rows: DataFrame, action: str, now, log: DataFrame) -> DataFrame:
    """Log rows for changes; ids follow the log's own, in the order of record, field and sequence."""
    top = log.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    for c in ("field", "old_value", "value", "editor_name"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    order = [c for c in ("record_id", "record_key", "field", "seq") if c in rows.columns]
    numbered = dense_numbers(rows.withColumn("_order", F.struct(*order)), "_order", "_n", F.lit(top))
    return numbered.select(F.col("_n").alias("id"), "record_key", F.col("record_id").cast("long").alias("record_id"), F.lit(action).alias("action"), "field", "old_value",
                           F.col("value").alias("new_value"), "editor_name", F.lit(now).cast("timestamp").alias("created_at"))


def create_records(cat: DataFrame, added: DataFrame, log: DataFrame, rows: DataFrame, editor: str, now) -> dict[str, DataFrame]:
    """Add rows (editable columns, ``seq``): new ``cat``, ``added``, ``log``.

    Ids follow the highest one.  A key that was added before keeps its creator
    and takes the new data.
    """
    clean = rows.select("seq", *(null_if_blank(f).alias(f) if f in rows.columns and f in EDITABLE_FIELDS else F.lit(None).cast("string").alias(f) for f in SOURCE_FIELDS))
    top = cat.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    made = dense_numbers(clean, "seq", "id", F.lit(top)).withColumns(derived_columns())
    new_cat = cat.unionByName(made.select(*cat.columns))
    data = F.to_json(F.struct(*EDITABLE_FIELDS), {"ignoreNullFields": "false"})
    latest = made.groupBy("record_key").agg(F.max_by(data, "seq").alias("_data"), F.max("id").alias("_id"))
    both = added.join(latest, "record_key", "full_outer")
    new = F.col("_data").isNotNull()
    new_added = both.select(
        F.coalesce("id", "_id").alias("id"), "record_key", F.coalesce("_data", "data").alias("data"), "editor_id", F.coalesce("editor_name", F.lit(editor)).alias("editor_name"),
        F.coalesce("created_at", F.lit(now).cast("timestamp")).alias("created_at"), F.when(new, F.lit(now).cast("timestamp")).otherwise(F.col("updated_at")).alias("updated_at")).select(*added.columns)
    changes = made.select(F.col("id").alias("record_id"), "record_key", "seq", record_label().alias("value"), F.lit(editor).alias("editor_name"))
    return {"cat": new_cat, "added": new_added, "log": log.unionByName(_logged(changes, "new", now, log), allowMissingColumns=True)}


PAIR = ["artist", "artist_credit", "title", "title_credit", "matrix_number", "label_number"]
SHARED = ["label", "country", "year", "format"]


def create_pairs(rows: DataFrame) -> DataFrame:
    """Two entries for the two songs of a record: ``seq``, ``side`` and the editable columns.

    ``rows`` has ``seq`` and structs ``a`` and ``b`` of editable columns.  Each
    entry names the other's song as its flip side; the second inherits label,
    country, year and format where blank, and exists only with a title or artist.
    """
    def entry(own: str, other: str, inherits: bool):
        out = []
        for f in EDITABLE_FIELDS:
            v = null_if_blank(F.col(f"{own}.{f}"))
            if f.startswith("b_side_") and f[7:] in PAIR:
                v = F.coalesce(null_if_blank(F.col(f"{other}.{f[7:]}")), v)
            elif inherits and f in SHARED:
                v = F.coalesce(v, null_if_blank(F.col(f"{other}.{f}")))
            out.append(v.alias(f))
        return F.struct(F.lit(own).alias("side"), *out)

    there = null_if_blank(F.col("b.title")).isNotNull() | null_if_blank(F.col("b.artist")).isNotNull()
    alone = F.struct(F.lit("a").alias("side"), *(null_if_blank(F.col(f"a.{f}")).alias(f) for f in EDITABLE_FIELDS))
    each = F.when(there, F.array(entry("a", "b", False), entry("b", "a", True))).otherwise(F.array(alone))
    return rows.select("seq", F.explode(each).alias("e")).select("seq", "e.*")


def delete_records(cat: DataFrame, overrides: DataFrame, added: DataFrame, tombstones: DataFrame, log: DataFrame, ids: DataFrame, editor: str, now) -> dict[str, DataFrame]:
    """Delete rows by ``id``: their corrections go, an added row goes, any other key gets a tombstone."""
    gone = cat.join(sized(ids.select("id").distinct()), "id", "left_semi").select("id", F.coalesce("record_key", record_key()).alias("record_key"), record_label().alias("label"))
    keys = gone.select("record_key").distinct()
    dead = gone.join(added.select("record_key").distinct(), "record_key", "left_anti").groupBy("record_key").agg(F.max_by("label", "id").alias("record_label"))
    marked = dead.select("record_key", "record_label", F.lit(None).cast("long").alias("editor_id"), F.lit(editor).alias("editor_name"), F.lit(now).cast("timestamp").alias("deleted_at"))
    changes = gone.select(F.col("id").alias("record_id"), "record_key", F.col("label").alias("old_value"), F.lit(editor).alias("editor_name"))
    return {
        "cat": cat.join(sized(ids.select("id").distinct()), "id", "left_anti"),
        "overrides": overrides.join(keys, "record_key", "left_anti"),
        "added": added.join(keys, "record_key", "left_anti"),
        "tombstones": tombstones.join(marked, "record_key", "left_anti").unionByName(marked),
        "log": log.unionByName(_logged(changes, "deleted", now, log), allowMissingColumns=True),
    }


def restore_deleted(tombstones: DataFrame, log: DataFrame, keys: DataFrame, editor: str, now) -> dict[str, DataFrame]:
    """Lift tombstones; the rows return with the next merge."""
    lifted = tombstones.join(keys.select("record_key").distinct(), "record_key", "left_semi")
    changes = lifted.select(F.lit(None).cast("long").alias("record_id"), "record_key", F.col("record_label").alias("value"), F.lit(editor).alias("editor_name"))
    return {"tombstones": tombstones.join(keys, "record_key", "left_anti"), "log": log.unionByName(_logged(changes, "restored", now, log), allowMissingColumns=True)}


def remove_overrides(cat: DataFrame, overrides: DataFrame, log: DataFrame, which: DataFrame, editor: str, now) -> dict[str, DataFrame]:
    """Withdraw corrections (record_key, field): the base returns where the stored row still has that key.

    The correction is deleted in every case.
    """
    taken = overrides.join(which.select("record_key", "field").distinct(), ["record_key", "field"], "left_semi")
    rows = cat.join(sized(taken.select(F.col("record_id").alias("id")).distinct()), "id", "left_semi").select(F.col("id").alias("record_id"), F.coalesce("record_key", record_key()).alias("_key"))
    valid = taken.join(rows, "record_id").filter((F.col("_key") == F.col("record_key")) & F.col("has_base") & F.col("field").isin(EDITABLE_FIELDS))
    per_row = valid.groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct(F.col("base_value").alias("v")).alias("v")))).alias("_base"))
    joined = cat.join(sized(per_row.withColumnRenamed("record_id", "id")), "id", "left")
    back = joined.withColumns({f: F.when(F.col("_base")[f].isNotNull(), F.col("_base")[f]["v"]).otherwise(F.col(f)) for f in EDITABLE_FIELDS})
    again = {k: v for k, v in derived_columns().items() if k != "record_key"}
    changes = valid.select("record_id", "record_key", "field", F.col("value").alias("old_value"), F.col("base_value").alias("value"), F.lit(editor).alias("editor_name"))
    return {"cat": back.withColumns(again).select(*cat.columns), "overrides": overrides.join(which, ["record_key", "field"], "left_anti"),
            "log": log.unionByName(_logged(changes, "reverted", now, log), allowMissingColumns=True)}


def backfill_base(overrides: DataFrame, log: DataFrame) -> DataFrame:
    """Corrections without a base get the old value of the earliest log row of their cell."""
    earliest = log.filter("field is not null").groupBy("record_key", "field").agg(F.min_by(F.struct(F.col("old_value").alias("v")), "id").alias("_first"))
    joined = overrides.join(earliest, ["record_key", "field"], "left")
    fill = ~F.coalesce("has_base", F.lit(False)) & F.col("_first").isNotNull()
    return joined.withColumns({"base_value": F.when(fill, F.col("_first.v")).otherwise(F.col("base_value")), "has_base": F.when(fill, True).otherwise(F.col("has_base"))}).select(*overrides.columns)


def backfill_record_key(cat: DataFrame) -> DataFrame:
    return cat.withColumn("record_key", F.coalesce("record_key", record_key()))


def category_edits(cat: DataFrame, fixes: DataFrame, editor: str) -> DataFrame:
    """The edit batch that turns every ``current`` value of a field into ``suggested``."""
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("current")) for f in ("country", "format", "genre")))).alias("c")
    rows = cat.select("id", cells).select("id", "c.*").join(sized(fixes.select("field", "current", "suggested")), ["field", "current"])
    return rows.select(F.col("id").alias("record_id"), "field", F.col("suggested").alias("value"), F.lit(editor).alias("editor_name"), F.lit(1).cast("long").alias("seq"))


def apply_category_fix(cat: DataFrame, overrides: DataFrame, added: DataFrame, log: DataFrame, fixes: DataFrame, editor: str, now) -> dict[str, DataFrame]:
    """Turn ``current`` values of fields into ``suggested`` as edits: new ``cat``, ``overrides``, ``added``, ``log``, as of :func:`apply_edits`."""
    return apply_edits(cat, overrides, added, log, category_edits(cat, fixes, editor), now)


def rename_editor(log: DataFrame, overrides: DataFrame, tombstones: DataFrame, old: str, new: str) -> dict[str, object]:
    """Rewrite an editor's name in five columns; returns the tables and the number of rows changed.

    The new name is cut at 120 characters; nothing happens when it is blank or
    the same.
    """
    new = new.strip()[:120]
    if not new or new == old:
        return {"log": log, "overrides": overrides, "tombstones": tombstones, "changed": 0}

    def swapped(df: DataFrame, columns: list[str]):
        n = df.agg(*(F.count_if(F.col(c) == old).alias(c) for c in columns)).first()
        return df.withColumns({c: F.when(F.col(c) == old, new).otherwise(F.col(c)) for c in columns}), sum(n)

    a, na = swapped(log, ["editor_name", "reviewed_by", "note_by"])
    b, nb = swapped(overrides, ["editor_name"])
    c, nc = swapped(tombstones, ["editor_name"])
    return {"log": a, "overrides": b, "tombstones": c, "changed": na + nb + nc}
