"""Multiset diff, import history and reconstruction of past states."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import content_hash
from ..schema import SOURCE_FIELDS
from ..storage import sized, stored

KEPT_PAYLOAD, KEPT_IMPORTS = 25_000, 10
#: ``op`` of the one change row that stands for the rows of a truncated import.
CUT = "cut"


#: Copies of a content that are made again in one task, and parts of its rows that a join by content meets in.
COPIES, PARTS = 100_000, 16


def numbered_copies(rows: DataFrame, order: str, descending: bool = False) -> DataFrame:
    """Number the copies of each ``hash`` from 1 in the order of a column: the columns of ``rows`` and ``rn``.

    Rows are dealt by ranges of (hash, column), so that the copies of a common
    content lie in as many ranges as they fill, and numbered within their range.
    Only the first hash of a range can have begun in an earlier one; as all
    earlier ranges that hold it end with it, running sums over one row a range
    give what to add.  Stored, so that a task that runs again can't deal the
    ranges otherwise.
    """
    by = [F.col("hash"), F.col(order).desc() if descending else F.col(order).asc()]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    at_hash = rows.columns.index("hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column(at_hash)
            new = np.ones(len(h), bool)
            new[1:] = pc.not_equal(h.slice(1), h.slice(0, len(h) - 1)).to_numpy(zero_copy_only=False)
            new[0] = h[0].as_py() != held
            at = np.arange(len(h))
            edge = np.maximum.accumulate(np.where(new, at, -1))
            rn = np.where(edge >= 0, at - edge + 1, n + at + 1)
            held, n = h[len(h) - 1].as_py(), int(rn[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rn.astype(np.int64))], names=[*batch.schema.names, "rn"])

    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("range", F.spark_partition_id())
    found = stored(dealt.mapInArrow(run, f"{kinds}, range int, rn long"), "copies")
    ends = found.groupBy("range").agg(F.min("hash").alias("first"), F.max(F.struct("hash", "rn")).alias("last")).select("range", "first", F.col("last.hash").alias("last"), F.col("last.rn").alias("n"))
    summed = ends.withColumn("sum", F.sum("n").over(Window.partitionBy("last").orderBy("range")))
    # one row a range: the bound of this window and of the broadcast
    before = Window.orderBy("range")
    offsets = summed.select("range", "first", F.when(F.lag("last").over(before) == F.col("first"), F.lag("sum").over(before)).otherwise(0).alias("add"))
    return found.join(F.broadcast(offsets), "range").select(*rows.columns, (F.col("rn") + F.when(F.col("hash") == F.col("first"), F.col("add")).otherwise(0)).alias("rn"))


def multiset_diff(live: DataFrame, target: DataFrame, order_col: str = "n") -> DataFrame:
    """Rows of either side by content: ``hash``, ``status``, ``id`` (live), ``n`` (target's file order).

    Of n live and m target copies min(n, m) are unchanged, the highest live ids
    first; other live copies are deleted, other target copies inserted.  Hashes
    and ids alone are shuffled: by ranges to be numbered, then by (hash, number)
    to be joined, so that copies of one content never meet in one task.
    """
    a = numbered_copies(live.select(content_hash().alias("hash"), "id"), "id", descending=True)
    b = numbered_copies(target.select(content_hash().alias("hash"), F.col(order_col).alias("n")), "n")
    status = F.when(F.col("n").isNull(), "delete").when(F.col("id").isNull(), "insert").otherwise("unchanged")
    return a.join(b, ["hash", "rn"], "full_outer").select("hash", status.alias("status"), "id", "n")


def dense_numbers(df: DataFrame, order: str, name: str, start: Column | int = 0) -> DataFrame:
    """Number rows from ``start`` + 1 in the order of a column, without a global window.

    The rows are sorted in ranges of the column and stored with their place in
    their range; the counts of the ranges give each one's offset.  Stored, so that
    a task that runs again can't deal the ranges otherwise.
    """
    place = F.monotonically_increasing_id()  # range number in the upper bits, place in the range in the lower 33
    ranged = stored(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_place", place), "ranges")
    part = F.shiftright("_place", 33)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_c"))
    # one row per range: the bound of this window and of the broadcast
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_off")
    at = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranged.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_off") + at + start).cast("long")).drop("_part", "_place", "_off")


def apply_diff(live: DataFrame, target: DataFrame, diff: DataFrame, order_col: str = "n") -> DataFrame:
    """The live rows without the deleted ones, and the inserted rows with ids from the highest on, in file order."""
    gone = diff.filter("status = 'delete'").select("id")
    top = live.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = target.join(diff.filter("status = 'insert'").select(F.col("n").alias(order_col)), order_col, "left_semi")
    numbered = dense_numbers(fresh, order_col, "id", F.lit(top))
    columns = [c for c in live.columns if c in numbered.columns]
    return live.join(gone, "id", "left_anti").unionByName(numbered.select(*columns), allowMissingColumns=True)


def record_import(history: DataFrame, changes: DataFrame, diff: DataFrame, live: DataFrame, target: DataFrame, now, order_col: str = "n", whole: bool = False, kept_rows: int | None = None, kept_imports: int | None = None) -> tuple[DataFrame, DataFrame]:
    """History and change rows after an import.

    Nothing is recorded when nothing changed.  With ``whole`` all changed rows
    are kept; else up to ``kept_rows`` (25,000), beyond which the entry is marked
    truncated and one row with op ``cut`` stands for them.  The newest
    ``kept_imports`` (10) entries stay.
    """
    kept_rows, kept_imports = KEPT_PAYLOAD if kept_rows is None else kept_rows, KEPT_IMPORTS if kept_imports is None else kept_imports
    n = diff.agg(F.count_if(F.col("status") == "insert").alias("i"), F.count_if(F.col("status") == "delete").alias("d"), F.count_if(F.col("status") != "insert").alias("l"), F.count_if(F.col("status") != "delete").alias("t")).first()
    if not n["i"] + n["d"]:
        return history, changes
    import_id = (history.agg(F.max("id")).first()[0] or 0) + 1
    truncated = not whole and n["i"] + n["d"] > kept_rows
    entry = history.sparkSession.createDataFrame([(import_id, now, n["i"], n["d"], n["t"], n["l"], truncated)], history.schema)
    kept = history.unionByName(entry).orderBy(F.desc("id")).limit(kept_imports)
    if truncated:
        changes = changes.unionByName(history.sparkSession.createDataFrame([(import_id, CUT)], "import_id long, op string"), allowMissingColumns=True)
    else:
        ins = target.join(diff.filter("status = 'insert'").select(F.col("n").alias(order_col)), order_col, "left_semi").select(F.lit(import_id).cast("long").alias("import_id"), F.lit("ins").alias("op"), *SOURCE_FIELDS)
        out = live.join(diff.filter("status = 'delete'").select("id"), "id", "left_semi").select(F.lit(import_id).cast("long").alias("import_id"), F.lit("del").alias("op"), *SOURCE_FIELDS)
        changes = changes.unionByName(ins).unionByName(out)
    return kept, changes.join(F.broadcast(kept.select(F.col("id").alias("import_id"))), "import_id", "left_semi")


def can_reconstruct(history: DataFrame, import_id: int) -> DataFrame:
    """One row, ``can``: there is an entry from ``import_id`` on, and none of those is truncated."""
    later = history.filter(F.col("id") >= import_id)
    return later.agg(((F.count("*") > 0) & F.coalesce(F.bool_and(~F.col("truncated")), F.lit(False))).alias("can"))


def net_reversal(changes: DataFrame, import_id: int) -> DataFrame:
    """What undoing all imports from ``import_id`` on comes to, by content: ``hash``, ``net``, source columns.

    Net is inserted less deleted copies: so many copies have to go, or to come
    back if it is negative.  Copies are exchangeable, so the order of imports
    doesn't matter.  ValueError if the rows of one of these imports were not kept.
    """
    later = changes.filter(F.col("import_id") >= import_id)
    cut = later.filter(F.col("op") == CUT).agg(F.min("import_id")).first()[0]
    if cut is not None:
        raise ValueError(f"the changed rows of import {cut} were not kept")
    later = later.withColumn("hash", content_hash())
    each = later.groupBy("hash").agg(F.sum(F.when(F.col("op") == "ins", 1).otherwise(-1)).alias("net"), F.min(F.struct(*SOURCE_FIELDS)).alias("row"))
    return each.filter("net <> 0").select("hash", "net", "row.*")


def reconstruct_before(live: DataFrame, changes: DataFrame, import_id: int) -> DataFrame:
    """Source columns of the rows as they were before an import, copies included; ValueError as in ``net_reversal``."""
    back = stored(net_reversal(changes, import_id), "reversal")
    hashed = live.withColumn("hash", content_hash())
    # only contents that lose copies are numbered; a common one meets its entry in as many parts
    losing = back.filter("net > 0").select("hash", F.col("net").alias("remove"))
    part = F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")
    dealt = sized(losing.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))))
    met = hashed.withColumn("_part", part).join(dealt, ["hash", "_part"], "left")
    rest = met.filter("remove is null").select(*SOURCE_FIELDS)
    gone = numbered_copies(met.filter("remove is not null").select("hash", "id", "remove"), "id").filter("rn <= remove").select("id")
    left = met.filter("remove is not null").join(gone, "id", "left_anti").select(*SOURCE_FIELDS)
    # copies that come back are made in pieces
    pieces = back.filter("net < 0").withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), -F.col("net") - 1, F.lit(COPIES).cast("long"))))
    some = F.least(F.lit(COPIES), -F.col("net") - F.col("_from")).cast("int")
    again = pieces.repartition("hash", "_from").withColumn("_x", F.explode(F.array_repeat(F.lit(1), some))).select(*SOURCE_FIELDS)
    return rest.unionByName(left).unionByName(again)


def list_imports(history: DataFrame) -> DataFrame:
    return history.orderBy(F.desc("id"))
