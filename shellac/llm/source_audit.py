"""Source divergence audit by single-pass in-memory indexing.

How far do the sources of a language differ in their words?  Every text is read
once.  A task builds the postings of a block (term, source, occurrences, documents)
in memory; when the block is full it becomes a run, sorted by term and cut at the
hash shards, and the next block begins.  A shard's runs meet in one task, which
merges them by a heap of one entry a run: every term comes out once, with its
occurrences in each source, and the terms in too few documents go.  The merged
frequencies are written, with each shard's share of the sums.

A pair of sources has a value for every kept term, but most terms are in few of
them.  Were no term anywhere, each would have the value of two floors; so many of
those is where a pair starts, and the terms stream by and add, for the sources that
hold them, what their value differs from it.  Parts of a language are summed up by
themselves, as are the bounded heaps of each source's own terms.

All values are whole numbers.  The corrections of a source, and what is returned,
have a row a pair of sources: the number of sources of one language must allow that.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, take_worker, written

#: Terms are runs of ASCII letters and signs beyond ASCII, bytes in UTF-8; A-Z are folded, all else parts terms.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
#: Entries of a block, about 100 bytes each, and of the sums of pairs, 8 bytes each.
BLOCK_ENTRIES, SUM_ENTRIES = 400_000, 4_000_000
SCALE, ADDED, LEAST_DOCS, TOP = 1_000_000_000, 2, 10, 10


class Block:
    """Postings in memory: occurrences by (language, source) and documents by language."""

    def __init__(self) -> None:
        self.counts: dict[tuple[str, str], Counter] = {}
        self.docs: dict[str, Counter] = {}
        self.entries = 0

    def add(self, lang: str, source: str, text: str) -> None:
        terms = text.encode().translate(FOLDED).split()
        counts, docs = self.counts.setdefault((lang, source), Counter()), self.docs.setdefault(lang, Counter())
        before = len(counts) + len(docs)
        counts.update(terms)
        docs.update(set(terms))
        self.entries += len(counts) + len(docs) - before

    def run(self, shards: int) -> Iterator[dict]:
        """The block as a run: a piece for each shard, its terms sorted; the term of no signs lists a language's sources."""
        keys, docs, at, names, numbers = [], [], [], sorted({s for _, s in self.counts}), []
        place = {s: i for i, s in enumerate(names)}
        for lang, found in self.docs.items():
            lead, base = lang.encode() + b"\0", len(keys)
            rank = {b"": base, **{t: base + 1 + i for i, t in enumerate(found)}}
            keys.extend(lead + t for t in rank)
            docs.append(np.fromiter((0, *found.values()), np.int64, len(rank)))
            for (other, source), counts in self.counts.items():
                if other == lang:
                    at.append(np.fromiter((base, *map(rank.__getitem__, counts)), np.int64, len(counts) + 1))
                    numbers.append(np.stack([np.full(len(at[-1]), place[source]), np.fromiter((0, *counts.values()), np.int64, len(at[-1]))]))
        if not keys:
            return
        shard = np.fromiter(map(zlib.crc32, keys), np.int64, len(keys)) % shards
        order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
        order = order[np.argsort(shard[order], kind="stable")]
        rank_of = np.empty(len(keys), np.int64)
        rank_of[order] = np.arange(len(keys))
        where, (source, count) = rank_of[np.concatenate(at)], np.concatenate(numbers, axis=1)
        by_term = np.argsort(where, kind="stable")
        ends = np.cumsum(np.bincount(where, minlength=len(keys)))
        source, count, docs = source[by_term].astype("<i4"), count[by_term].astype("<i8"), np.concatenate(docs)[order]
        edges = np.searchsorted(shard[order], np.arange(shards + 1))
        for k in np.flatnonzero(edges[1:] > edges[:-1]):
            low, high = int(edges[k]), int(edges[k + 1])
            first, last = int(ends[low - 1]) if low else 0, int(ends[high - 1])
            own = [keys[i] for i in order[low:high].tolist()]
            yield {
                "shard": int(k), "first": own[0], "keys": own, "docs": docs[low:high].astype("<i8").tobytes(), "ends": (ends[low:high] - first).astype("<i8").tobytes(),
                "names": names, "sources": source[first:last].tobytes(), "counts": count[first:last].tobytes()}


PIECE = pa.schema([
    ("shard", pa.int32()), ("first", pa.binary()), ("keys", pa.list_(pa.binary())), ("docs", pa.binary()), ("ends", pa.binary()),
    ("names", pa.list_(pa.string())), ("sources", pa.binary()), ("counts", pa.binary())])
PIECE_SQL = "shard int, first binary, keys array<binary>, docs binary, ends binary, names array<string>, sources binary, counts binary"


def _runs(rows: DataFrame, shards: int, most: int) -> DataFrame:
    """The runs of all blocks, a row per run and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("source_audit")

        def spilled(block: Block) -> Iterator[pa.RecordBatch]:
            pieces = list(block.run(shards))
            for at in range(0, len(pieces), 100):
                yield pa.RecordBatch.from_pylist(pieces[at : at + 100], schema=PIECE)

        block = Block()
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block.add(lang, source, text)
                if block.entries >= most:
                    yield from spilled(block)
                    block = Block()
        yield from spilled(block)

    return rows.mapInArrow(run, PIECE_SQL)


def _entries(piece: dict, known: dict[str, int]) -> Iterator[tuple[bytes, int, np.ndarray, np.ndarray]]:
    """(key, documents, sources, occurrences) of a run's piece, in order; sources by their number in ``known``, which learns new ones."""
    docs, ends = np.frombuffer(piece["docs"], "<i8").tolist(), np.frombuffer(piece["ends"], "<i8").tolist()
    number = np.array([known.setdefault(s, len(known)) for s in piece["names"]], np.int64)
    sources, counts = number[np.frombuffer(piece["sources"], "<i4")], np.frombuffer(piece["counts"], "<i8")
    start = 0
    for key, n, end in zip(piece["keys"], docs, ends, strict=True):
        yield key, n, sources[start:end], counts[start:end]
        start = end


def merged_runs(pieces: Iterator[dict], known: dict[str, int]) -> Iterator[tuple[bytes, int, list]]:
    """(key, documents, (sources, occurrences) of each run that holds it) for every key of a shard; ``pieces`` come by their first key.

    A heap holds one entry of each run that has begun; a run is opened when its
    first key is due.
    """
    heap: list = []
    coming = next(pieces, None)
    opened = 0
    while heap or coming:
        while coming and (not heap or coming["first"] <= heap[0][0]):
            entries = _entries(coming, known)
            entry = next(entries)
            heapq.heappush(heap, (entry[0], opened, entry, entries))
            opened += 1
            coming = next(pieces, None)
        key, docs, postings = heap[0][0], 0, []
        while heap and heap[0][0] == key:
            _, number, entry, entries = heap[0]
            docs += entry[1]
            postings.append(entry[2:])
            after = next(entries, None)
            if after:
                heapq.heapreplace(heap, (after[0], number, after, entries))
            else:
                heapq.heappop(heap)
        yield key, docs, postings


def _frequencies(runs: DataFrame, least: int) -> DataFrame:
    """Kept terms: ``lang``, ``term``, ``sources``, ``counts``; with the term '' the sums of a task, and how many terms it kept (``kept``)."""
    fields = [("lang", pa.string()), ("term", pa.string()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("kept", pa.int64())]

    def packed(langs: list, terms: list, groups: list, counts: list, kept: list, names: pa.Array) -> pa.RecordBatch:
        ends = pa.array(np.cumsum([0, *map(len, groups)]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, x) for x in (names.take(pa.array(np.concatenate(groups))), pa.array(np.concatenate(counts)))]
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(terms, pa.string()), *lists, pa.array(kept, pa.int64())], schema=pa.schema(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("source_audit")
        known: dict[str, int] = {}
        sums: dict[str, np.ndarray] = {}
        kept: Counter = Counter()
        rows: list[tuple] = []
        pieces = (piece for batch in batches for i in range(batch.num_rows) for piece in batch.slice(i, 1).to_pylist())
        for key, docs, postings in _shards(pieces, known):
            lead, _, term = key.rpartition(b"\0")
            if term and docs < least:
                continue
            own, at = np.unique(np.concatenate([x for x, _ in postings]), return_inverse=True)
            total = np.zeros(len(own), np.int64)
            np.add.at(total, at, np.concatenate([x for _, x in postings]))
            lang = lead.decode()
            summed = sums.get(lang)
            if summed is None or len(summed) < len(known):
                sums[lang] = summed = np.concatenate((np.full(0, -1) if summed is None else summed, np.full(2 * len(known) - (0 if summed is None else len(summed)), -1)))
            summed[own] = np.maximum(summed[own], 0) + total  # -1: not a source of this language
            if term:
                kept[lang] += 1
                rows.append((lang, term.decode(), own, total, None))
            if len(rows) >= 1000:
                yield packed(*map(list, zip(*rows, strict=True)), pa.array(known, pa.string()))
                rows.clear()
        for lang, summed in sums.items():
            own = np.flatnonzero(summed >= 0)
            rows.append((lang, "", own, summed[own], kept[lang]))
        if rows:
            yield packed(*map(list, zip(*rows, strict=True)), pa.array(known, pa.string()))

    return runs.mapInArrow(run, "lang string, term string, sources array<string>, counts array<long>, kept long")


def _shards(pieces: Iterator[dict], known: dict[str, int]) -> Iterator[tuple[bytes, int, list]]:
    """The merged keys of one shard after the other; the pieces of a shard follow each other."""
    held = next(pieces, None)
    while held:
        shard, rest = held["shard"], [held]

        def own() -> Iterator[dict]:
            while rest[0] and rest[0]["shard"] == shard:  # noqa: B023
                piece, rest[0] = rest[0], next(pieces, None)  # noqa: B023
                yield piece

        yield from merged_runs(own(), known)
        held = rest[0]


def share(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE (count + ADDED) / whole), digit by digit, exact for wholes below 9e15."""
    at, rest = np.divmod(count + ADDED, whole)
    for _ in range(3):
        rest = rest * 1000
        more = rest // whole
        at, rest = at * 1000 + more, rest - more * whole
    return at + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Part:
    """What the terms of a part of a language add to its pairs, and the bounded heaps of its sources."""

    def __init__(self, lang: str, names: list[str], counts: np.ndarray, kept: int):
        self.lang, self.names = lang, pa.array(names, pa.string())
        self.place = {s: i for i, s in enumerate(names)}
        self.whole, self.all = counts + ADDED * kept, np.int64(counts.sum() + ADDED * kept)
        self.none = share(np.zeros(len(names), np.int64), self.whole) if kept else None
        self.room = max(1, SUM_ENTRIES // max(1, len(names)))
        self.slots: dict[int, int] = {}
        self.sums = np.zeros((min(self.room, len(names)), len(names)), np.int64)
        self.heaps: list[list] = [[] for _ in names]
        self.least = np.full(len(names), -1, np.int64)
        self.seen = 0

    def places(self, names: list[str]) -> np.ndarray:
        """The places of these sources; of those of other languages -1."""
        return np.array([self.place.get(s, -1) for s in names], np.int64)

    def add(self, term: str, held: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A term that the sources at the places ``held`` have so many times; gives the sums when they are full."""
        own = share(counts, self.whole[held])
        whole = share(counts.sum(), self.all)
        value = apart(own, whole)
        self.seen += 1
        for k in np.flatnonzero((own > whole) & (value > self.least[held])):
            i, heap = int(held[k]), self.heaps[held[k]]
            (heapq.heappush if len(heap) < TOP else heapq.heappushpop)(heap, (int(value[k]), -self.seen, term))
            if len(heap) == TOP:
                self.least[i] = heap[0][0]
        p, there = self.none.copy(), np.zeros(len(self.none), bool)
        p[held], there[held] = own, True
        before = np.arange(len(p))[None, :] < held[:, None]
        for at in range(0, len(held), self.room):
            rows = held[at : at + self.room]
            if len(self.slots) + sum(int(i) not in self.slots for i in rows) > len(self.sums):
                yield self.pairs()
            change = apart(p[rows][:, None], p[None, :]) - apart(self.none[rows][:, None], self.none[None, :])
            change[there[None, :] & before[at : at + self.room]] = 0  # pairs of which both hold the term are counted once
            self.sums[[self.slots.setdefault(int(i), len(self.slots)) for i in rows]] += change

    def pairs(self) -> pa.RecordBatch:
        """The sums so far, which start anew."""
        rows = np.array(list(self.slots), np.int64)
        slot, other = np.nonzero(self.sums[: len(rows)])
        value = self.sums[slot, other]
        own = rows[slot] if len(rows) else slot
        self.sums[:] = 0
        self.slots = {}
        n = len(value)
        return pa.RecordBatch.from_arrays(
            [pa.array([self.lang] * n, pa.string()), self.names.take(pa.array(np.minimum(own, other))), self.names.take(pa.array(np.maximum(own, other))), pa.nulls(n, pa.string()), pa.array(value)],
            names=["lang", "a", "b", "term", "value"])

    def terms(self) -> pa.RecordBatch:
        rows = [(self.lang, self.names[i].as_py(), None, term, value) for i, heap in enumerate(self.heaps) for value, _, term in heap]
        return pa.RecordBatch.from_pylist([dict(zip(("lang", "a", "b", "term", "value"), r, strict=True)) for r in rows], schema=SUMS)


SUMS = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("term", pa.string()), ("value", pa.int64())])


def _corrections(streams: DataFrame) -> DataFrame:
    """Per part: what its terms add to pairs (``a``, ``b``), and the best terms of each source (``a``, ``term``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("source_audit")
        part = None
        for batch in batches:
            langs, terms, sources, counts, kept = (batch.column(c) for c in ("lang", "term", "sources", "counts", "kept"))
            ends, coded, numbers = sources.offsets.to_numpy() - sources.offsets[0].as_py(), sources.flatten().dictionary_encode(), counts.flatten().to_numpy()
            codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            place = part and part.places(names)
            for i, term in enumerate(terms.to_pylist()):
                own, n = codes[ends[i] : ends[i + 1]], numbers[ends[i] : ends[i + 1]]
                if term:
                    yield from part.add(term, place[own], n)
                    continue
                if part:
                    yield part.pairs()
                    yield part.terms()
                part = Part(langs[i].as_py(), [names[k] for k in own], n, kept[i].as_py())
                place = part.places(names)
        if part:
            yield part.pairs()
            yield part.terms()

    return streams.mapInArrow(run, "lang string, a string, b string, term string, value long")


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST_DOCS, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """How far sources of a language differ: ``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``.

    A language keeps the terms in at least ``least`` of its rows.  Part ``pair``
    has each other source of the language, part ``term`` the ten terms that set a
    source apart most; ranks go by value, then by the item's bytes.  Null texts,
    languages and sources count as ''.  Rows that repeat an id, or have none,
    count one by one.  A group without terms is compared like all others; where a
    language keeps no term, its pairs have the value 0.  An empty table gives no
    rows; further columns are not read.
    """
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    runs = _runs(rows, shards, block_entries).repartition(shards, "shard").sortWithinPartitions("shard", "first")
    freq = written(_frequencies(runs, least), "frequencies")

    sums = freq.filter("term = ''")
    n = sums.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("g")).groupBy("lang", F.col("g.sources").alias("source")).agg(F.sum("g.counts").alias("n"))
    own = n.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("groups"))
    groups = written(own.join(sums.groupBy("lang").agg(F.sum("kept").alias("kept")), "lang"), "groups")

    parts = max(1, shards // 4)
    lead = groups.filter("kept > 0").select("lang", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit("").alias("term"), F.col("groups.source").alias("sources"), F.col("groups.n").alias("counts"), "kept")
    terms = freq.filter("term <> ''").select("lang", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("part"), "term", "sources", "counts", "kept")
    streams = lead.unionByName(terms).repartition("lang", "part").sortWithinPartitions("lang", "part", "term")
    changes = written(_corrections(streams), "corrections")
    dropped(freq)

    floor_of = F.when(F.col("kept") > 0, F.expr(f"1L + {ADDED * SCALE}L div (n + {ADDED}L * kept)")).otherwise(F.lit(1).cast("long"))

    each = groups.select("lang", "kept", "groups", F.posexplode("groups").alias("at", "g")).select("lang", "kept", "at", "g.source", "g.n", "groups")
    spread = each.repartition("lang", "source").withColumn("p", floor_of)
    later = spread.select("lang", "kept", "p", F.col("source").alias("a"), F.explode(F.expr("slice(groups, at + 2, size(groups))")).alias("g"))
    start = later.select("lang", "kept", "p", "a", F.col("g.source").alias("b"), F.col("g.n").alias("n")).withColumn("q", floor_of)
    value = F.expr("kept * ((p - q) * (p - q) div (p + q))")
    pairs = start.select("lang", "a", "b", value.alias("value")).unionByName(changes.filter("b is not null").select("lang", "a", "b", "value")).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    listed = pairs.select("lang", both.alias("e"), "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    found = listed.unionByName(changes.filter("b is null").select("lang", F.col("a").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return found.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= TOP))
