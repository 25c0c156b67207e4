"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions.

An item's window is found in a document only if the document holds every shingle
of the window, so one shingle of each window is a necessary prefix.  Shingles
(pairs of neighbouring words, single words for one-word windows) are ordered by
how often the corpus holds them; each window keeps its rarest one.  Documents'
shingles are joined with these prefix shingles, the length and positional bounds
say whether the whole window fits around the match, and the words of the
window's place are compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Characters that part words: ASCII other than letters (upper case is folded first) and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Prefix shingles are broadcast up to this many windows (about 0.4 kB each); beyond it the joins shuffle.
BROADCAST_WINDOWS = 50_000
#: Words of a document that are looked up together, with as many around them as a window may reach: no row holds a long text for each of its words.
SEGMENT = 64


def words(text: Column, separators: str = SEPARATORS) -> Column:
    """Words in A-Z lower-cased text; null and wordless texts give an empty array."""
    folded = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(folded, separators), lambda w: w != "")


def windows_of(items: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """Distinct windows: ``window`` (words), ``win_id``, ``items`` (those that hold it)."""
    w = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1)))
    each = w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("window"))
    return each.groupBy("window").agg(F.collect_set("item").alias("items")).withColumn("win_id", F.xxhash64(F.concat_ws(" ", "window")))


def shingle(w: Column, i: Column) -> Column:
    """Hash of the pair of words at positions i and i + 1, from 1."""
    return F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1))


def shingled(windows: DataFrame) -> DataFrame:
    """A row per shingle of each window: ``win_id``, ``window``, ``len``, ``at`` (from 0), ``sh``."""
    single = F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(F.element_at("window", 1)).alias("sh")))
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("window") - 1))
    paired = F.transform(places, lambda i: F.struct((i - 1).alias("at"), shingle(F.col("window"), i).alias("sh")))
    each = F.explode(F.when(F.size("window") == 1, single).otherwise(paired)).alias("s")
    return windows.select("win_id", "window", F.size("window").alias("len"), each).select("win_id", "window", "len", "s.at", "s.sh")


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows apart, also those without an id."""
    return F.xxhash64(doc_id, text)


def find_windows(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", size: int = 13,
) -> DataFrame:
    """For each row of ``docs``: ``doc_id``, ``row_key``, ``n_words``, ``n_hit``, ``item_ids``.

    A window is ``size`` consecutive words of an item, or the whole of an item
    with fewer words but not none.  ``n_hit`` counts the document's words inside
    any occurrence of a window, ``item_ids`` lists the items with occurring
    windows, sorted as strings.  Null texts have no words and no hits.  Rows are
    judged one by one, also those that repeat an id or have none; items of equal
    text are all listed.  Without items nothing is hit.  The windows are counted
    before any of them is broadcast.
    """
    windows = written(windows_of(items, item_col, item_text_col, size), "windows")
    lengths = windows.agg(F.count("*").alias("n"), F.count_if(F.size("window") == 1).alias("one")).first()
    small = lengths["n"] <= BROADCAST_WINDOWS
    sized = F.broadcast if small else (lambda df: df)

    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("row_key"), words(F.col(text_col)).alias("w"))
    n = F.size("w")
    pairs = F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: shingle(F.col("w"), i))).otherwise(F.array().cast("array<bigint>"))
    # single words follow the pairs, for the windows of one word
    found = F.concat(pairs, F.transform("w", lambda x: F.xxhash64(x))) if lengths["one"] else pairs

    known = shingled(windows)
    counts = rows.select(F.explode(found).alias("sh")).join(sized(known.select("sh").distinct()), "sh", "left_semi").groupBy("sh").count()
    rarest = known.join(sized(counts), "sh").groupBy("win_id").agg(
        F.count("*").alias("met"), F.min(F.struct("count", "at", "sh")).alias("p"), F.first("window").alias("window"), F.first("len").alias("len"))
    # a window with a shingle that no document holds occurs nowhere
    prefix = written(rarest.filter(F.col("met") == F.greatest(F.lit(1), F.col("len") - 1)).select("win_id", "window", "len", "p.at", "p.sh"), "prefix")

    def segment(base: Column) -> Column:
        low = F.greatest(F.lit(0), base - size)
        return F.struct(base.alias("base"), low.alias("low"), F.slice("w", low + 1, SEGMENT + 2 * size).alias("w"))

    def looked_up(last: Column, sh) -> Column:
        """(pos, sh) of the segment's own places up to ``last``."""
        to = F.least(F.col("base") + (SEGMENT - 1), last)
        each = F.transform(F.sequence("base", F.greatest("base", to)), lambda p: F.struct(p.alias("pos"), sh(p - F.col("low") + 1).alias("sh")))
        return F.when(to >= F.col("base"), each).otherwise(F.array().cast("array<struct<pos:int,sh:bigint>>"))

    bases = F.when(n > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), n - 1), F.lit(SEGMENT))).otherwise(F.array().cast("array<int>"))
    segments = rows.select("row_key", n.alias("n"), F.explode(F.transform(bases, segment)).alias("s")).select("row_key", "n", "s.*")
    of_pairs = looked_up(F.col("n") - 2, lambda i: shingle(F.col("w"), i))
    of_words = looked_up(F.col("n") - 1, lambda i: F.xxhash64(F.element_at("w", i)))
    places = segments.select("row_key", "n", "low", "w", F.explode(F.concat(of_pairs, of_words) if lengths["one"] else of_pairs).alias("f")).select("row_key", "n", "low", "w", "f.pos", "f.sh")
    start = F.col("pos") - F.col("at")
    fits = (start >= 0) & (start + F.col("len") <= F.col("n"))
    if small:
        same = F.slice("w", start - F.col("low") + 1, F.col("len")) == F.col("window")
        matched = places.join(F.broadcast(prefix), "sh").filter(fits).filter(same).select("row_key", "win_id", start.alias("start"), "len")
    else:
        lean = places.drop("w", "low").join(prefix.drop("window"), "sh").filter(fits).select("row_key", "win_id", start.alias("start"), "len")
        matched = (
            lean.join(prefix.select("win_id", "window"), "win_id").join(rows.select("row_key", "w").distinct(), "row_key")
            .filter(F.slice("w", F.col("start") + 1, F.col("len")) == F.col("window")).select("row_key", "win_id", "start", "len")
        )
    matched = written(matched, "matched")

    # within one document: as many spans and items as its own words and windows at most
    spans = F.sort_array(F.collect_set(F.struct(F.col("start"), (F.col("start") + F.col("len")).alias("end"))))
    covered = F.aggregate(
        spans, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("reach")),
        lambda a, s: F.struct((a["sum"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["reach"], s["start"]))).alias("sum"), F.greatest(a["reach"], s["end"]).alias("reach")),
        lambda a: a["sum"])
    hit = matched.groupBy("row_key").agg(covered.cast("long").alias("n_hit"))
    per_item = matched.select("row_key", "win_id").distinct().join(sized(windows.select("win_id", F.explode("items").alias("item"))), "win_id")
    held = per_item.groupBy("row_key").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    both = hit.join(held, "row_key")
    return rows.select("doc_id", "row_key", n.cast("long").alias("n_words")).join(both, "row_key", "left").select(
        "doc_id", "row_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def contaminated(n_words: Column, n_hit: Column) -> Column:
    """A document is contaminated if at least a twentieth of its words are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
