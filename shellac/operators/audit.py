"""Audits of the catalogue: contradicting numbers, split releases, category spellings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blank, dismiss_key, norm_key, record_key, release_base, shared_prefix, side_marker_number, side_rank, spelling_key
from ..storage import sized, stored


def _k(c: str):
    return F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))


#: Rows of a side that meet in one task.
GRID_ROWS = 2_000


def grid_join(a: DataFrame, b: DataFrame, keys: list[str], a_id: str, b_id: str, most: int = GRID_ROWS) -> DataFrame:
    """An inner join on ``keys`` in which common keys are dealt to a grid.

    Both sides are counted by a hash of their keys.  Where one has more than
    ``most`` rows, its rows fall in parts by their id, each part goes to all parts
    of the other side, and a cell of the grid is a join key of its own: a task gets
    ``most`` rows of either side, whatever the planner knows of the skew.
    """
    h = F.xxhash64(*keys).alias("_h")
    counts = [side.groupBy(h).agg(F.count("*").alias(n)) for side, n in ((a, "_a"), (b, "_b"))]
    parts = [F.ceil(F.col(n) / most).cast("int").alias(n) for n in ("_a", "_b")]
    common = stored(counts[0].join(counts[1], "_h").filter((F.col("_a") > most) | (F.col("_b") > most)).select("_h", *parts), "common")
    if not common.limit(1).count():
        return a.join(b, keys)
    side = sized(common)

    def dealt(rows: DataFrame, id_col: str, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        met = rows.withColumn("_h", h).join(side, "_h", "left")
        part = F.coalesce(F.pmod(F.xxhash64(id_col), F.col(own)), F.lit(0)).alias(names[0])
        return met.select(*rows.columns, part, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)).alias(names[1]))

    left, right = dealt(a, a_id, "_a", "_b", ("_i", "_j")), dealt(b, b_id, "_b", "_a", ("_j", "_i"))
    return left.join(right, [*keys, "_i", "_j"]).drop("_i", "_j")


def matrix_mismatches(cat: DataFrame, limit: int | None = None) -> DataFrame:
    """Songs that another row names as its flip side with another matrix number.

    Rows are joined on title, artist, label, country, format and year (lower
    case, trimmed, null as empty); titles and both numbers have to be filled and
    the numbers to differ.  Blank keys are filtered before the join; a title that
    very many rows share is dealt to a grid.  Label, country, year and format are
    the song's own.
    """
    shared = ["label", "country", "format", "year"]
    own = cat.filter(~blank("title") & ~blank("matrix_number")).select(
        F.col("id").alias("own_id"), F.col("title").alias("own_title"), F.col("artist").alias("own_artist"), F.col("label").alias("own_label"), F.col("matrix_number").alias("own_matrix"), F.col("label_number").alias("own_label_number"),
        "country", "year", "format", F.coalesce("record_key", record_key()).alias("own_key"), _k("title").alias("k0"), _k("artist").alias("k1"), *(_k(c).alias(f"k{i + 2}") for i, c in enumerate(shared)))
    stub = cat.filter(~blank("b_side_title") & ~blank("b_side_matrix_number")).select(
        F.col("id").alias("stub_id"), F.col("b_side_matrix_number").alias("stub_matrix"), F.col("label_number").alias("stub_label_number"), F.coalesce("record_key", record_key()).alias("stub_key"),
        _k("b_side_title").alias("k0"), _k("b_side_artist").alias("k1"), *(_k(c).alias(f"k{i + 2}") for i, c in enumerate(shared)))
    met = grid_join(own, stub, [f"k{i}" for i in range(6)], "own_id", "stub_id")
    pairs = met.filter("own_id <> stub_id").filter(F.lower(F.trim("own_matrix")) != F.lower(F.trim("stub_matrix")))
    out = pairs.select(
        "own_id", "stub_id", "own_title", "own_artist", "own_label", "own_label_number", "stub_label_number", "country", "year", "format", "own_matrix", "stub_matrix",
        shared_prefix("own_matrix", "stub_matrix").alias("shared"), dismiss_key("own_key", "stub_key", "own_matrix", "stub_matrix").alias("dismiss_key"))
    ordered = out.orderBy("own_label", "own_matrix", "own_id", "stub_id") if limit else out
    return ordered.limit(limit) if limit else out


def open_mismatches(pairs: DataFrame, dismissed: DataFrame, limit: int = 500) -> DataFrame:
    """The first mismatches that nobody set aside, with ``pos``, ``capped`` and ``dismissed_total``."""
    keys = dismissed.select("dismiss_key").distinct()
    left = pairs.join(keys, "dismiss_key", "left_anti")
    order = ["own_label", "own_matrix", "own_id", "stub_id"]
    first = left.orderBy(*order).limit(limit + 1)
    placed = first.withColumn("pos", F.row_number().over(Window.orderBy(*order)))
    totals = keys.agg(F.count("*").alias("dismissed_total"))
    over = first.agg((F.count("*") > limit).alias("capped"))
    return placed.filter(F.col("pos") <= limit).crossJoin(F.broadcast(over)).crossJoin(F.broadcast(totals))


def dismiss(dismissed: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """Set findings aside; those set aside before stay as they are."""
    return dismissed.unionByName(findings.dropDuplicates(keys).join(dismissed.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def undismiss(dismissed: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    return dismissed.join(findings.select(*keys).distinct(), keys, "left_anti")


def list_dismissed(dismissed: DataFrame, n: int = 500) -> DataFrame:
    """The newest ``n`` pairs set aside."""
    return dismissed.orderBy(F.desc("dismissed_at"), "dismiss_key").limit(n)


#: More entries than this are a number in reuse, not sides of one record.
LARGEST_RELEASE = 6


def release_groups(cat: DataFrame, tracks: bool = False) -> DataFrame:
    """Releases entered as several rows: ``anchors`` and ``siblings``, ids of at most six rows, with ``tracks`` their songs.

    Rows share the release base of their label number, label, format and year; a
    sibling's number begins with the base.  Groups of more than six are none, and
    a side numbered two or more is needed somewhere.  A row whose own number
    doesn't begin with the base has a group of its own with these siblings.  Keys
    are stored once and counted before anything is gathered, so that a number in
    reuse never meets in one task.
    """
    base = norm_key(release_base("label_number"))
    side = [F.struct(F.lit(i).alias("side"), *(F.col(f"{p}{c}").alias(c) for c in ("label_number", "artist", "title"))) for i, p in enumerate(("", "b_side_"))]
    rows = cat.filter(release_base("label_number").isNotNull()).select(
        "id", base.alias("base"), F.struct(F.lower(F.trim("label")).alias("lab")).alias("lab"), norm_key("format").alias("fmt"), norm_key("year").alias("yr"),  # a struct: equal also where both are null
        F.lower("label_number").startswith(base).alias("is_sib"),
        F.greatest(F.coalesce(side_marker_number("label_number"), F.lit(0)), F.coalesce(side_marker_number("b_side_label_number"), F.lit(0))).alias("mark"),
        *([F.filter(F.array(*side), lambda t: ~blank(t["title"])).alias("sides")] if tracks else []))
    rows = stored(rows, "release_keys")
    keys = ["base", "lab", "fmt", "yr"]
    few = rows.groupBy(*keys).agg(F.count_if("is_sib").alias("sibs"), F.count("*").alias("all"), F.max("mark").alias("most")).filter((F.col("sibs") > 0) & (F.col("sibs") <= LARGEST_RELEASE) & (F.col("all") > 1) & (F.col("most") >= 2))
    met = rows.join(few.select(*keys, "sibs"), keys)
    made = [F.flatten(F.collect_list(F.transform("sides", lambda t: F.struct(F.col("id").alias("id"), t["side"].alias("side"), t["label_number"].alias("label_number"), t["artist"].alias("artist"), t["title"].alias("title"), F.concat_ws("|", norm_key(t["artist"]), norm_key(t["title"])).alias("k"))))).alias("tracks")] if tracks else []
    groups = met.filter("is_sib").groupBy(*keys).agg(F.collect_list("id").alias("siblings"), F.max("mark").alias("top"), *made)
    names = ["anchors", "siblings", *["tracks"] * tracks]
    own = groups.filter("top >= 2 and size(siblings) > 1").withColumn("anchors", F.col("siblings")).select(*names)
    apart = met.filter(~F.col("is_sib") & (F.col("sibs") < LARGEST_RELEASE)).select(*keys, F.array("id").alias("anchors"), "mark", *(["id", "sides"] if tracks else []))
    joined = apart.join(groups, keys).filter(F.greatest("mark", "top") >= 2)
    if tracks:
        mine = F.transform("sides", lambda t: F.struct(F.col("id").alias("id"), t["side"].alias("side"), t["label_number"].alias("label_number"), t["artist"].alias("artist"), t["title"].alias("title"), F.concat_ws("|", norm_key(t["artist"]), norm_key(t["title"])).alias("k")))
        joined = joined.withColumn("tracks", F.concat("tracks", mine))
    return own.unionByName(joined.select(*names))


def release_siblings(cat: DataFrame) -> DataFrame:
    """Entries of one release, as of :func:`release_groups`: ``id``, ``sibling_id``."""
    groups = release_groups(cat)
    return groups.select("siblings", F.explode("anchors").alias("id")).select("id", F.explode("siblings").alias("sibling_id")).filter("id <> sibling_id")


def release_tracks(groups: DataFrame) -> DataFrame:
    """Every song of a release once, for each of its entries: ``anchor_id``, ``position``, song, ``here``.

    ``groups`` has the tracks of each release, gathered once.  Of the occurrences
    of a song the first with a label number stands for it, else the first, its own
    entry's before others; sides are in the order of their marks.
    """
    each = groups.select("tracks", F.explode("anchors").alias("anchor_id"))
    placed = F.array_sort(F.transform("tracks", lambda t: F.struct((t["id"] != F.col("anchor_id")).alias("a"), t["id"].alias("b"), t["side"].alias("c"), t["k"].alias("k"), t["label_number"].alias("label_number"), t["artist"].alias("artist"), t["title"].alias("title"))))
    each = each.select("anchor_id", placed.alias("t"))
    song = F.filter("t", lambda x, i: ~F.exists(F.slice("t", 1, i), lambda u: u["k"] == x["k"]))
    numbered = lambda x: F.filter("t", lambda u: (u["k"] == x["k"]) & (F.coalesce(u["label_number"], F.lit("")) != ""))
    best = F.transform(song, lambda x: F.struct(F.coalesce(F.get(numbered(x), 0), x).alias("best"), F.struct(x["a"], x["b"], x["c"]).alias("first"), (~x["a"]).alias("here")))
    ordered = F.array_sort(F.transform(best, lambda x: F.struct(side_rank(x["best"]["label_number"]).alias("rank"), x["first"].alias("first"), x["here"].alias("here"), x["best"].alias("best"))))
    one = each.select("anchor_id", F.posexplode(ordered).alias("at", "e"))
    return one.select("anchor_id", (F.col("at") + 1).alias("position"), "e.best.label_number", "e.best.artist", "e.best.title", F.col("e.best.b").alias("record_id"), "e.here")


def stub_mismatches(cat: DataFrame, siblings: DataFrame) -> DataFrame:
    """Siblings that name this song as their flip side with another matrix or label number."""
    own = cat.select("id", "title", "matrix_number", "label_number")
    other = cat.select(F.col("id").alias("sibling_id"), F.col("label_number").alias("sibling_label_number"), "b_side_title", "b_side_matrix_number", "b_side_label_number")
    met = siblings.join(own, "id").join(other, "sibling_id").filter(~blank("title") & (norm_key("b_side_title") == norm_key("title")))
    pairs = F.array(
        F.struct(F.lit("matrix number").alias("field"), F.col("matrix_number").alias("here"), F.col("b_side_matrix_number").alias("there")),
        F.struct(F.lit("label number").alias("field"), F.col("label_number").alias("here"), F.col("b_side_label_number").alias("there")))
    each = met.select("id", "sibling_id", "sibling_label_number", F.explode(pairs).alias("p")).select("id", "sibling_id", "sibling_label_number", "p.*")
    return each.filter(~blank("here") & (norm_key("here") != norm_key("there")))


CATEGORY_FIELDS = ["country", "format", "genre"]


def category_values(cat: DataFrame) -> DataFrame:
    """``field``, ``value``, ``n`` of the three category columns, in one pass."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in CATEGORY_FIELDS))).alias("e")
    return cat.select(each).select("e.*").filter(F.trim("value") != "").groupBy("field", "value").agg(F.count("*").alias("n"))


SUGGESTION = ["field", "current", "current_n", "suggested", "suggested_n", "kind"]


def format_variants(cat: DataFrame) -> DataFrame:
    """Values that differ in case, spacing or signs only: each but the most frequent, with that one suggested."""
    values = category_values(cat).withColumn("k", spelling_key("value")).filter((F.col("k") != "") & ~F.trim("value").endswith("?"))
    w = Window.partitionBy("field", "k").orderBy(F.desc("n"), "value")
    ranked = values.withColumns({"rn": F.row_number().over(w), "suggested": F.first("value").over(w), "suggested_n": F.first("n").over(w)})
    return ranked.filter("rn > 1").select("field", F.col("value").alias("current"), F.col("n").alias("current_n"), "suggested", "suggested_n", F.lit("formatting").alias("kind"))


#: Known misspellings by field (fixed values).
MISSPELLINGS = [
    ("country", "Scandanavia", "Scandinavia"), ("country", "Guatamala", "Guatemala"), ("country", "Phillipines", "Philippines"), ("country", "New Zealnd", "New Zealand"),
    ("country", "Suth Africa", "South Africa"), ("country", "Mrxico", "Mexico"), ("country", "Perus", "Peru"),
    ("genre", "Caltpso // Traditional", "Calypso // Traditional"), ("genre", "Drum N Base", "Drum N Bass"),
]


def known_misspellings(cat: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """Listed misspellings that occur and that :func:`format_variants` hasn't reported."""
    listed = cat.sparkSession.createDataFrame(MISSPELLINGS, "field string, value string, suggested string")
    values = category_values(cat)
    found = values.join(F.broadcast(listed), ["field", "value"])
    right = values.select("field", F.col("value").alias("suggested"), F.col("n").alias("suggested_n"))
    out = found.join(right, ["field", "suggested"], "left").select("field", F.col("value").alias("current"), F.col("n").alias("current_n"), "suggested", F.coalesce("suggested_n", F.lit(0)).alias("suggested_n"), F.lit("spelling").alias("kind"))
    return out.join((variants if variants is not None else format_variants(cat)).select("field", "current"), ["field", "current"], "left_anti").select(*SUGGESTION)


def category_suggestions(cat: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Both kinds of suggestions without those set aside (field, value), the most frequent first in each field."""
    variants = format_variants(cat)
    found = variants.unionByName(known_misspellings(cat, variants))
    return found.join(dismissed.select("field", F.col("value").alias("current")), ["field", "current"], "left_anti").select(*SUGGESTION).orderBy("field", F.desc("current_n"), "current")
