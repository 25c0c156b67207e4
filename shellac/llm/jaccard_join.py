"""N-gram Jaccard join by parity sketches.

Equal sets form one class, found by a 128-bit digest.  A class has a sketch of
64-bit parts: every shingle XORs its hash into the one part it belongs to, so two
sketches differ in no more parts than the sets differ in elements.  Sets fall in
size bands; linked sets lie in the same or in neighbouring bands and differ in at
most D elements (from the band's largest size).  A sketch of the band has
P = D + 1 + e + s parts, so linked sets agree in e + 1 + s parts (pigeonhole), and
in e + 1 filled ones unless both have more than s empty parts; only such sets join
on their empty parts too.  Classes are joined on (band, part, bits): a class that
shares fewer than e + 1 keys with any others links with none and is done.

The classes that are left are compared by their elements, rarest first: two sets
that link share one of the first n - o + 1 elements of each, where o is the overlap
that sets of their sizes need.  Members of a crowded cluster mostly have more
elements of their own than that, so they meet nobody.  One round of stars comes
first: every element names as pivot its member with the fewest elements of its own,
and all its members are compared with the pivot.  What still stands in different
components and meets the bounds of size and position is then compared, each pair
once.  A pair is first held against the Hamming distance of two short parity
sketches, a lower bound of the symmetric difference, and then checked exactly.
There are two rounds whatever the size of a group, and no link is lost between
components.  "Exact" is meant up to collisions of 64-bit shingle hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, rest_worker, take_worker, written
from .components import components
from .language_model import tokens, word_hashes

#: Representatives' ids are broadcast up to this many (16 MB); beyond it their texts are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Parts beyond the least number, as a share of D: so many more keys must two linked sets share.
EXTRA = 0.15


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of the whole sequence if it has fewer words."""
    words = tokens(text)
    if not words:
        return np.zeros(0, np.uint64)
    w = np.array(word_hashes(words), np.uint64)
    n = min(size, len(w))
    h = np.full(len(w) - n + 1, n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(n):
        h ^= w[k : len(w) - n + 1 + k]
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    return h * np.uint64(0x94D049BB133111EB)


@cache
def band(n: int, percent: int) -> int:
    """The size band of a set of n elements: its lowest size."""
    low = 1
    while (to := 100 * low // percent + 1) <= n:
        low = to
    return low


@cache
def band_below(low: int, percent: int) -> int | None:
    return band(low - 1, percent) if low > 1 else None


@cache
def parts_of(low: int, percent: int) -> tuple[int, int, int, int]:
    """(D, extra, spare, parts) of the band from ``low``: most differing elements, extra and spare parts, all parts."""
    high = 100 * low // percent
    t = Fraction(percent, 100)
    most = math.floor((1 - t) / (1 + t) * (high + math.floor(high / t)))
    extra, spare = int(EXTRA * most), 0
    for _ in range(20):
        p = most + 1 + extra + spare
        empty = p * math.exp(-low / p)
        spare = math.ceil(empty + 3 * math.sqrt(empty))
    return most, extra, spare, most + 1 + extra + spare


def sketch_keys(h: np.ndarray, low: int, percent: int) -> np.ndarray:
    """Join keys of the set ``h`` in the band from ``low``: one for each filled part, and for empty ones if they are many."""
    most, _, spare, parts = parts_of(low, percent)
    if most == 0:
        return np.zeros(0, np.int64)  # only equal sets link
    at = (mixed(h, low) >> np.uint64(16)) % np.uint64(parts)
    at = at.astype(np.uint16 if parts < 65536 else np.int64)
    order = np.argsort(at, kind="stable")
    at = at[order]
    edge = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
    bits = np.bitwise_xor.reduceat(mixed(h, 1)[order], edge)
    where = at[edge].astype(np.uint64)
    if parts - len(edge) > spare:
        empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), where)
        where, bits = np.concatenate((where, empty)), np.concatenate((bits, np.zeros(len(empty), np.uint64)))
    return mixed(bits ^ mixed(where + np.uint64(low << 20), 2), 3).view(np.int64)


def keys_of(h: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The keys of a set in its own band and the one below, and how many of them a linked set shares at least."""
    low = band(len(h), percent)
    below = band_below(low, percent)
    keys, need = sketch_keys(h, low, percent), parts_of(low, percent)[1] + 1
    if below:
        keys, need = np.concatenate((keys, sketch_keys(h, below, percent))), min(need, parts_of(below, percent)[1] + 1)
    return keys, need


def digest(h: np.ndarray) -> tuple[int, int] | tuple[None, None]:
    """Two 64-bit halves that stand for the set; nulls for the empty set."""
    if not len(h):
        return None, None
    n = np.uint64(len(h))
    halves = [mixed(np.add.reduce(mixed(h, salt), keepdims=True) + n, salt + 1).view(np.int64)[0] for salt in (5, 7)]
    return int(halves[0]), int(halves[1])


def _sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(id, n, lo, hi, need, keys) per row; keys only for the first row with an id of a class in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("words")
        met: set[tuple[int, int]] = set()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            named = ids.is_valid().to_pylist()
            for at in range(0, len(texts), 100):
                n, lo, hi, need, keys = [], [], [], [], []
                for text, has_id in zip(texts[at : at + 100], named[at : at + 100], strict=True):
                    h = shingles(text, size)
                    kind = digest(h)
                    n.append(len(h))
                    lo.append(kind[0])
                    hi.append(kind[1])
                    own, least = None, None
                    if len(h) and has_id and kind not in met:
                        if len(met) < 500_000:
                            met.add(kind)
                        own, least = keys_of(h, percent)
                    keys.append(own)
                    need.append(least)
                columns = [pa.array(x, pa.int64()) for x in (n, lo, hi, need)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(n)), *columns, pa.array(keys, pa.list_(pa.int64()))],
                    names=["id", "n", "lo", "hi", "need", "keys"])
        met.clear()
        rest_worker()

    return docs.mapInArrow(run, "id long, n long, lo long, hi long, need long, keys array<long>")


#: 64-bit words of a set's short sketch, and their columns.
WORDS = 16
BITS = [f"w{i}" for i in range(WORDS)]


def short_sketch(h: np.ndarray) -> np.ndarray:
    """1024 bits, one flipped by each element: sketches differ in no more bits than the sets in elements."""
    odd = np.bincount((mixed(h, 4) >> np.uint64(54)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _hashed(docs: DataFrame, size: int) -> DataFrame:
    """(id, c, s, n, short sketch) per row; c tells the sets of a repeated id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("words")
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for at in range(0, len(texts), 100):
                sets = [shingles(t, size) for t in texts[at : at + 100]]
                bits = np.array([short_sketch(h) for h in sets], np.int64).reshape(len(sets), WORDS)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, len(sets)), pa.array([digest(h)[0] for h in sets], pa.int64()),
                        pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64())), pa.array([len(h) for h in sets], pa.int64()),
                        *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(WORDS)),
                    ],
                    names=["id", "c", "s", "n", *BITS])
        rest_worker()

    return docs.mapInArrow(run, "id long, c long, s array<long>, n long, " + ", ".join(f"{b} long" for b in BITS))


def _near(a: str, b: str, percent: int) -> Column:
    """What linked sets must fulfil by their sizes and short sketches: the sketches' distance and the sizes' are at most the sets'."""
    most = (100 - percent) * (F.col(f"{a}.n") + F.col(f"{b}.n"))
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in BITS])
    return ((100 + percent) * F.abs(F.col(f"{a}.n") - F.col(f"{b}.n")) <= most) & ((100 + percent) * apart <= most)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: first by their short sketches, then by exact sizes of intersection and union."""
    short = sets.select("id", "n", *BITS)
    a, b = short.alias("x"), short.alias("y")
    met = pairs.join(a, F.col("a") == F.col("x.id")).join(b, F.col("b") == F.col("y.id")).filter(_near("x", "y", percent)).select("a", "b").distinct()
    near = written(met, "near")
    full = sets.select("id", "s")
    left = near.join(full.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    both = left.join(full.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    counted = both.select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb") - common).alias("all"))
    out = written(counted.filter(100 * F.col("common") >= percent * F.col("all")).select("a", "b").distinct(), "links")
    dropped(near)
    return out


def join(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate groups of whole texts: ``doc_id``, ``n_shingles``, ``component_id``, ``n_class``.

    A-Z is lower-cased, words are parted by ASCII white space; a set holds the
    distinct ``size``-word shingles, of a shorter text the whole sequence.  Texts
    link when intersection / union >= percent / 100.  ``component_id`` is the
    least id reachable by links, ``n_class`` the number of rows of the same set.
    One row for each row.  Texts without words (null, blank) link with nothing:
    their component is their own id.  Rows that repeat an id count as copies of
    one document.  A null id has no component and takes no part.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketched = written(_sets(rows, size, percent), "sketches")
    classes = _classes(sketched)
    involved = _involved(sketched, classes)
    sets = written(sketched.select("id", "n", "lo", "hi"), "sets")
    dropped(sketched)
    named = sets.filter("lo is not null and id is not null")
    edges = _links(rows, involved, size, percent)

    # rows that repeat an id with other texts tie the classes of that id together
    again = named.groupBy("id").agg(F.min("lo").alias("x"), F.max("lo").alias("y"), F.min("hi").alias("z"), F.max("hi").alias("w")).filter("x <> y or z <> w").select(F.col("id").alias("a"))
    tied = named.join(classes.select("lo", "hi", "rep"), ["lo", "hi"]).filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    if again.limit(1).count():
        tied = written(tied.join(again, "a", "left_semi"), "tied")
        edges = tied if edges is None else edges.unionByName(tied)
    if edges is None:
        groups = classes.withColumn("component_id", F.col("rep"))
    else:
        grouped = components(edges)
        dropped(edges, tied)
        groups = classes.join(grouped.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    out = sets.join(groups.select("lo", "hi", "component_id", "n_class"), ["lo", "hi"], "left")
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"), F.coalesce("n_class", F.lit(1)).alias("n_class"))


def _classes(sketched: DataFrame) -> DataFrame:
    """(lo, hi, rep, n_class) per class of equal sets."""
    named = sketched.filter("lo is not null and id is not null")
    return written(named.groupBy("lo", "hi").agg(F.min("id").alias("rep"), F.count("*").alias("n_class")), "classes")


def _involved(sketched: DataFrame, classes: DataFrame) -> DataFrame:
    """Ids of the classes that share as many keys with others as a linked class must.

    A key's least and greatest class come from an aggregate that Spark sums up
    before the shuffle; the join back may be split where a key is crowded.
    """
    keyed = sketched.filter("keys is not null").select("lo", "need", F.explode("keys").alias("key"))
    shared = written(keyed.groupBy("key").agg(F.min("lo").alias("x"), F.max("lo").alias("y")).filter("x <> y").select("key"), "shared")
    counted = keyed.join(shared, "key", "left_semi").distinct().groupBy("lo").agg(F.count("*").alias("keys"), F.min("need").alias("need"))
    enough = written(counted.filter("keys >= need").select("lo"), "enough")
    out = written(classes.join(enough, "lo", "left_semi").select(F.col("rep").alias("id")).distinct(), "involved")
    dropped(shared, enough)
    return out


def _overlap(n: Column, m: Column, percent: int) -> Column:
    """Common elements that sets of n and m elements need in order to link."""
    return F.ceil((percent * (n + m)) / (100 + percent) - 1e-6)


def _rare(sets: DataFrame, percent: int) -> DataFrame:
    """(id, c, n, h, own, at): the elements in which a set may meet others, each with its place in the set, rarest first.

    ``own`` is the number of elements that no other set has; they stand first.
    """
    each = sets.select("id", "c", "n", F.explode("s").alias("h"))
    common = written(each.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1"), "common")
    found = each.join(common, "h").groupBy("id", "c", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("f"))
    own = (F.col("n") - F.size("f")).alias("own")
    first = F.col("n") - F.ceil(percent * F.col("n") / 100 - 1e-6) + 1
    cut = found.select("id", "c", "n", own, F.slice("f", 1, F.greatest(F.lit(0), first - F.col("n") + F.size("f")).cast("int")).alias("f"))
    placed = cut.select("id", "c", "n", "own", F.posexplode("f").alias("k", "e"))
    out = written(placed.select("id", "c", "n", "own", F.col("e.h").alias("h"), (F.col("own") + F.col("k")).alias("at")), "rare")
    dropped(common)
    return out


def _links(rows: DataFrame, involved: DataFrame, size: int, percent: int) -> DataFrame | None:
    """Links (a, b) that connect whatever links connect; None if there is none."""
    n_involved = involved.count()
    if not n_involved:
        return None
    ids = F.broadcast(involved) if n_involved <= BROADCAST_IDS else involved
    theirs = rows.join(ids, "id", "left_semi")
    if theirs.groupBy("id").count().filter("count > 1").limit(1).count():
        theirs = theirs.distinct()  # a repeated id has several sets: all of them are compared
    sets = written(_hashed(theirs, size), "elements")
    rare = _rare(sets, percent)

    # one round of stars
    pivots = rare.groupBy("h").agg(F.min(F.struct("own", "id")).alias("p"), F.min("id").alias("x"), F.max("id").alias("y")).filter("x <> y").select("h", F.col("p.id").alias("pivot"))
    star = rare.join(pivots, "h").filter("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    edges = _linked(star, sets, percent)
    label = components(edges)

    # the pairs that are left between components
    tagged = rare.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed_ = tagged.groupBy("h").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("n").alias("least")).filter("x <> y").select("h", "least")
    smallest = F.greatest(F.col("least"), F.ceil(percent * F.col("n") / 100 - 1e-6))
    open_ = written(tagged.join(mixed_, "h").filter(F.col("at") <= F.col("n") - _overlap(F.col("n"), smallest, percent)).select("h", "id", "n", "at", "component"), "open")
    a, b = open_.alias("a"), open_.alias("b")
    need = _overlap(F.col("a.n"), F.col("b.n"), percent)
    meet = (F.col("a.h") == F.col("b.h")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.component") != F.col("b.component"))
    fits = (need <= F.least("a.n", "b.n")) & (F.col("a.at") <= F.col("a.n") - need) & (F.col("b.at") <= F.col("b.n") - need)
    pairs = a.join(b, meet & fits).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    rest = _linked(pairs, sets, percent)
    out = written(edges.unionByName(rest), "all_links")
    dropped(edges, rest, label, open_, rare, sets, involved)
    return out
