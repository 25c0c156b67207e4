"""Faceted browsing: indexes, letters, unknown values, rows of a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import is_uncertain
from ..schema import FACETS, RESULT_COLUMNS
from ..storage import sized, stored
from .search import order_keys, paged

UNKNOWN = "__unknown__"


def facet_index(cat: DataFrame, facet: str, letter: str | None = None) -> DataFrame:
    """Values of a facet: ``value``, ``label`` (as the first row shows it), ``n``.

    Uncertain values are left out; with a letter only the values it begins
    (``#``: outside a to z), a filter on the stored column below the grouping.
    """
    value, shown, _ = FACETS[facet]
    rows = cat.filter(F.col(value).isNotNull() & ~is_uncertain(value))
    test = letter_test(facet, letter)
    if test is not None:
        rows = rows.filter(test)
    return rows.groupBy(F.col(value).alias("value")).agg(F.min_by(shown, "id").alias("label"), F.count("*").alias("n"))


def letter_test(facet: str, letter: str | None, column: str | None = None) -> Column | None:
    value, _, whole = FACETS[facet]
    if letter is None or whole or facet == "years":
        return None
    c = F.col(column or value)
    if letter == "#":
        return (c < "a") | (c >= "{")
    low = letter.lower() if len(letter) == 1 and "a" <= letter.lower() <= "z" else "a"
    return (c >= low) & (c < chr(ord(low) + 1))


def facet_indexes(cat: DataFrame) -> DataFrame:
    """All nine indexes in one pass: ``facet``, ``value``, ``label``, ``n``."""
    each = F.array(*(F.struct(F.lit(f).alias("facet"), F.col(v).alias("value"), F.col(s).alias("shown")) for f, (v, s, _) in FACETS.items()))
    rows = cat.select("id", F.explode(each).alias("e")).select("id", "e.*").filter(F.col("value").isNotNull() & ~is_uncertain("value"))
    return rows.groupBy("facet", "value").agg(F.min_by("shown", "id").alias("label"), F.count("*").alias("n"))


def facet_entries(rows: DataFrame) -> DataFrame:
    """What each row adds to the indexes: ``id``, ``facet``, ``value``, ``shown``; a null value for rows without one, nothing for uncertain ones."""
    each = F.array(*(F.struct(F.lit(f).alias("facet"), F.col(v).alias("value"), F.col(s).alias("shown")) for f, (v, s, _) in FACETS.items()))
    return rows.select("id", F.explode(each).alias("e")).select("id", "e.*").filter(F.col("value").isNull() | ~is_uncertain("value"))


def facet_table(cat: DataFrame) -> DataFrame:
    """The nine indexes as a table that imports keep up to date: ``facet``, ``value``, ``id``, ``label``, ``n``.

    ``id`` is the row that shows the value; a null value counts the rows without one.
    """
    return facet_entries(cat).groupBy("facet", "value").agg(F.min("id").alias("id"), F.min_by("shown", "id").alias("label"), F.count("*").alias("n"))


def by_range(table: DataFrame) -> DataFrame:
    """A table of indexes in the order of its values, so that a file's statistics tell which letters are in it."""
    return table.repartitionByRange("facet", F.col("value").asc_nulls_last()).sortWithinPartitions("facet", F.col("value").asc_nulls_last())


def updated_facets(table: DataFrame, deleted: DataFrame, inserted: DataFrame, live: DataFrame) -> DataFrame:
    """The table of indexes after an import that deleted and inserted these rows; ``live`` is the catalogue after it.

    Counts go down and up.  A value is shown by its row of the least id: if that
    row went, by the least one among the rows that are left, for which ``live`` is
    looked through for these values only.
    """
    shown = F.struct("id", "label")
    none = F.lit(None).cast("long")
    old = table.select("facet", "value", "n", shown.alias("old"), none.alias("gone"), F.lit(None).cast(table.select(shown).schema[0].dataType).alias("come"))
    minus = facet_entries(deleted).groupBy("facet", "value").agg(F.count("*").alias("n"), F.min("id").alias("gone"))
    plus = facet_table(inserted).select("facet", "value", "n", shown.alias("come"))
    changes = minus.select("facet", "value", (-F.col("n")).alias("n"), "gone").unionByName(plus, allowMissingColumns=True)
    each = old.unionByName(changes, allowMissingColumns=True).groupBy("facet", "value").agg(
        F.sum("n").alias("n"), F.min("old").alias("old"), F.min("gone").alias("gone"), F.min("come").alias("come")).filter("n > 0")
    lost = F.coalesce(F.col("gone") == F.col("old.id"), F.lit(False))
    kept = each.filter(~lost).select("facet", "value", F.least("old", "come").alias("rep"), "n").select("facet", "value", "rep.id", "rep.label", "n")
    broken = stored(each.filter(lost).select("facet", "value", "n"), "broken")
    mine = facet_entries(live).alias("x").join(sized(broken).alias("y"), (F.col("x.facet") == F.col("y.facet")) & F.col("x.value").eqNullSafe(F.col("y.value")))
    again = mine.groupBy("x.facet", "x.value", "y.n").agg(F.min("id").alias("id"), F.min_by("shown", "id").alias("label"))
    return kept.unionByName(again.select("facet", "value", "id", "label", "n"))


def index_range(table: DataFrame, facet: str, letter: str | None = None) -> DataFrame:
    """:func:`facet_index` from the stored table: the filter reaches the files as a range of values."""
    rows = table.filter((F.col("facet") == facet) & F.col("value").isNotNull())
    test = letter_test(facet, letter, "value")
    return (rows if test is None else rows.filter(test)).select("value", "label", "n")


def facet_unknown(cat: DataFrame, facet: str, letter: str | None = None) -> DataFrame:
    """The index with a last row for the rows without a value, when all or ``#`` is listed."""
    found = facet_index(cat, facet, letter).withColumn("last", F.lit(0))
    whole = FACETS[facet][2] or facet == "years"
    if not (whole or letter in (None, "#")):
        return found
    none = cat.filter(F.col(FACETS[facet][0]).isNull()).agg(F.count("*").alias("n")).filter("n > 0")
    return found.unionByName(none.select(F.lit(UNKNOWN).alias("value"), F.lit("Unknown").alias("label"), "n", F.lit(1).alias("last")))


def facet_rows(cat: DataFrame, facet: str, value: str, sort: str | None = None, direction: str | None = None, page: object = 1) -> DataFrame:
    """A page of the rows of a value, with ``page_pos``, ``total`` and ``heading``."""
    column, shown, _ = FACETS[facet]
    rows = cat.filter(F.col(column).isNull() if value == UNKNOWN else F.col(column) == value)
    total = rows.count()
    out = paged(rows, order_keys(sort, direction, total), page, total=total)
    if value == UNKNOWN:
        return out.select(*RESULT_COLUMNS, "page_pos", "total", F.lit("Unknown").alias("heading"))
    if shown not in RESULT_COLUMNS:
        return out.select(*RESULT_COLUMNS, "page_pos", "total", F.lit(value).alias("heading"))
    first = out.agg(F.min_by(shown, "page_pos").alias("heading"))  # one row
    return out.select(*RESULT_COLUMNS, "page_pos", "total").crossJoin(F.broadcast(first))


def facet_groups(index: DataFrame) -> DataFrame:
    """A small index by the first letter of its labels: ``letter`` ('#' for others), ``items`` in order."""
    first = F.upper(F.substring("label", 1, 1))
    letter = F.when(first.rlike("^[A-Z]$"), first).otherwise("#")
    return index.groupBy(letter.alias("letter")).agg(F.sort_array(F.collect_list(F.struct("value", "label", "n"))).alias("items"))
