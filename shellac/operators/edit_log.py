"""Reports over the edit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blank, record_key
from ..storage import sized
from .search import Keys, as_order, paged

NOTE_LENGTH = 2_000


NEWEST: Keys = [("created_at", True), ("id", True)]


def record_log(log: DataFrame, n: int = 50) -> DataFrame:
    """The newest ``n`` rows of every record, with their place ``rn``."""
    rn = F.row_number().over(Window.partitionBy("record_key").orderBy(*as_order(NEWEST)))
    return log.withColumn("rn", rn).filter(F.col("rn") <= n)


def log_filter(kind: str) -> Column:
    return {"unreviewed": F.col("reviewed_at").isNull(), "reviewed": F.col("reviewed_at").isNotNull(), "noted": F.col("note").isNotNull()}.get(kind, F.lit(True))


def global_log(log: DataFrame, kind: str = "all", page: object = 1) -> DataFrame:
    """A page of the log, newest first, with ``page_pos``, ``total`` and ``unreviewed``."""
    n = log.agg(F.count_if(log_filter(kind)).alias("total"), F.count_if(F.col("reviewed_at").isNull()).alias("unreviewed")).first()
    return paged(log.filter(log_filter(kind)), NEWEST, page, total=n["total"]).withColumn("unreviewed", F.lit(n["unreviewed"]).cast("long"))


def resolve_live_ids(log: DataFrame, cat: DataFrame) -> DataFrame:
    """The row a log entry is about now: ``id``, ``live_id``.

    The least id with the entry's key, else the entry's own row if its contents
    still give that key, else null.  The catalogue is reduced to one id per key
    before the join.
    """
    keys = sized(log.select("record_key").distinct())
    by_key = cat.join(keys, "record_key", "left_semi").groupBy("record_key").agg(F.min("id").alias("_by_key"))
    own = cat.select(F.col("id").alias("record_id"), record_key().alias("_now"))
    joined = log.select("id", "record_key", "record_id").join(sized(by_key), "record_key", "left").join(sized(own), "record_id", "left")
    return joined.select("id", F.coalesce("_by_key", F.when(F.col("_now") == F.col("record_key"), F.col("record_id"))).alias("live_id"))


def review_log(log: DataFrame, decisions: DataFrame, reviewer: str, now) -> DataFrame:
    """Set or clear reviews and notes: ``decisions`` has ``id``, ``reviewed`` (null: leave), ``note`` (null: leave, '' clears)."""
    d = decisions.select("id", "reviewed", F.substring(F.trim("note"), 1, NOTE_LENGTH).alias("new_note"))
    joined = log.join(sized(d), "id", "left")
    at, none = F.lit(now).cast("timestamp"), F.lit(None)

    def by(test: Column, value: Column, column: str) -> Column:
        return F.when(test, value).otherwise(F.col(column))

    yes, no = F.col("reviewed"), ~F.col("reviewed")
    given, cleared = F.col("new_note") != "", F.col("new_note") == ""
    return joined.withColumns({
        "reviewed_at": F.when(no, none).otherwise(by(yes, at, "reviewed_at")), "reviewed_by": F.when(no, none).otherwise(by(yes, F.lit(reviewer), "reviewed_by")),
        "note": F.when(cleared, none).otherwise(by(given, F.col("new_note"), "note")), "note_at": F.when(cleared, none).otherwise(by(given, at, "note_at")),
        "note_by": F.when(cleared, none).otherwise(by(given, F.lit(reviewer), "note_by")),
    }).select(*log.columns)


def editor_names(log: DataFrame) -> DataFrame:
    """Everyone who edited, reviewed or noted: ``name``, ``n`` (their edits)."""
    each = F.explode(F.array(F.struct(F.col("editor_name").alias("name"), F.lit(1).alias("n")), F.struct(F.col("note_by").alias("name"), F.lit(0).alias("n")), F.struct(F.col("reviewed_by").alias("name"), F.lit(0).alias("n")))).alias("e")
    return log.select(each).select("e.*").filter(~blank("name")).groupBy("name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "name")


def review_counts(log: DataFrame) -> DataFrame:
    """Noted changes per editor and the number of unreviewed changes: ``editor_name``, ``noted``, ``unreviewed``."""
    return log.groupBy("editor_name").agg(F.count_if(F.col("note").isNotNull()).alias("noted"), F.count_if(F.col("reviewed_at").isNull()).alias("unreviewed"))


def list_overrides(overrides: DataFrame) -> DataFrame:
    return overrides.orderBy(F.desc("updated_at"), "record_key", "field")


def list_deleted(tombstones: DataFrame) -> DataFrame:
    return tombstones.orderBy(F.desc("deleted_at"), "record_key")
