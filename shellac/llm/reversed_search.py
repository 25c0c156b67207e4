"""Ranked lexical search in reverse: documents stream through an index of the items.

The items are few and the documents are many, so the index is made of the items:
for each of their terms, who holds it and how often.  It is bounded, item block by
item block, and sent to every task.  One pass counts the documents that hold each
of its terms, a second one scores: a document's counts of the index's terms meet
their lists, the sums per item are its scores, and each item's heap of the best so
far takes those that beat its least.  A task returns its heaps, at most ``top``
rows an item; heaps are merged in two steps, by item and a part of the tasks first.
No document is stored or sent.  All sums are 64-bit integers.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, take_worker, written

#: Terms are runs of ASCII letters, digits and signs beyond ASCII, bytes in UTF-8; A-Z are folded, all else parts terms.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
#: Terms of the items of one block, repeats included: the index has 12 bytes an entry and a term's own bytes.
BLOCK_TERMS = 2_000_000
TOP = 20
#: Parts of an item whose heaps are merged first.
PARTS = 16


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLDED).split()


class Index:
    """For each term of some items: its number, and (item, how often) of those that hold it, in arrays."""

    def __init__(self, texts: list[str | None]):
        held: dict[bytes, list[tuple[int, int]]] = {}
        for i, text in enumerate(texts):
            for term, n in Counter(terms(text)).items():
                held.setdefault(term, []).append((i, n))
        self.number = {t: k for k, t in enumerate(held)}
        sizes = np.array([len(x) for x in held.values()], np.int64)
        self.first = np.concatenate(([0], np.cumsum(sizes)))
        flat = [e for entries in held.values() for e in entries]
        self.items = np.array([i for i, _ in flat], np.int32)
        self.times = np.array([n for _, n in flat], np.int64)
        self.n_items = len(texts)

    def scores(self, numbers: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Sums over these terms of their values, as often as an item holds them, for every item."""
        low = self.first[numbers]
        n = self.first[numbers + 1] - low
        at = np.arange(n.sum()) + np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        out = np.zeros(self.n_items, np.int64)
        np.add.at(out, self.items[at], np.repeat(values, n) * self.times[at])
        return out


def _counted(rows: DataFrame, index) -> DataFrame:
    """Sums of the tasks: documents by term number; documents with a term at -1, all their terms at -2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("reversed_search")
        number = index.value.number
        found = np.zeros(len(number), np.int64)
        docs = length = 0
        for batch in batches:
            for text in batch.column(1):
                own = terms(text.as_py())
                docs += bool(own)
                length += len(own)
                met = [number[t] for t in number.keys() & set(own)]
                found[met] += 1
        if docs:
            some = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((some, [-1, -2]))), pa.array(np.concatenate((found[some], [docs, length])))], names=["term", "n"])

    return rows.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _scored(rows: DataFrame, index, figures, top: int) -> DataFrame:
    """The heaps of the tasks: ``item``, ``doc_id``, ``score``, and a ``part`` of the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("reversed_search")
        own, (weights, n_docs, length) = index.value, figures.value
        number = own.number
        heaps: list[list] = [[] for _ in range(own.n_items)]
        least = np.ones(own.n_items, np.int64)  # a score above 0 is asked for
        for batch in batches:
            for doc, text in zip(*batch.columns, strict=True):
                all_terms = terms(text.as_py())
                counts = Counter(all_terms)
                met = number.keys() & counts.keys()
                if not met:
                    continue
                doc_id = doc.as_py()
                place = -math.inf if doc_id is None else -doc_id
                numbers, tf = np.array([number[t] for t in met], np.int64), np.array([counts[t] for t in met], np.int64)
                m = 75 + 25 * len(all_terms) * n_docs // length
                scores = own.scores(numbers, weights[numbers] * (1_000_000_000 * tf // (1000 * tf + 12 * m)))
                for i in np.flatnonzero(scores >= least).tolist():
                    heap = heaps[i]
                    if len(heap) < top:
                        heapq.heappush(heap, (int(scores[i]), place))
                    else:
                        heapq.heappushpop(heap, (int(scores[i]), place))
                    if len(heap) == top:
                        least[i] = heap[0][0]
        found = [(i, None if place == -math.inf else -place, score) for i, heap in enumerate(heaps) for score, place in heap]
        for at in range(0, len(found), 10_000):
            item, doc_ids, score = zip(*found[at : at + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return rows.mapInArrow(run, "item long, doc_id long, score long").withColumn("part", F.spark_partition_id() % PARTS)


def search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    top: int = TOP, block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """The ``top`` documents for each item: ``item_id``, ``rank`` (from 1), ``doc_id``, ``score``.

    Scores are positive, the highest first, equal ones by ascending id, rows
    without an id last; ranks are unique, so rows that repeat an id are ranked one
    by one.  Items that repeat an id, or have none, are ranked by themselves.
    Null and empty texts have no terms: such items get no rows, such documents
    are in none and don't count.  An empty table gives no rows; further columns
    are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # an item by its place in the order of ids and texts; blocks of them go to the driver one after the other
    asked = written(items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).filter(F.length("text") > 0), "items")
    kind = asked.schema["item_id"].dataType.simpleString()
    out = None
    taken = asked.orderBy("item_id", "text").toLocalIterator()
    parts = []
    for block in _blocks(taken, block_terms):
        index = spark.sparkContext.broadcast(Index([r["text"] for r in block]))
        counts = {r["term"]: r["n"] for r in _counted(rows, index).collect()}  # a row a term of the block at most
        n_docs, length = counts.get(-1, 0), counts.get(-2, 0)
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counts.get(k, 0) + 1))) for k in range(len(index.value.number))], np.int64)
        best = _scored(rows, index, spark.sparkContext.broadcast((weights, n_docs, length)), top)
        order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
        for key in (["item", "part"], ["item"]):
            best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("rank") <= top)
        ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], f"item long, item_id {kind}")
        parts.append(written(best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"), "ranked"))
    for part in parts:
        out = part if out is None else out.unionByName(part)
    dropped(asked)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if out is None else out


def _blocks(rows: Iterator, most: int) -> Iterator[list]:
    """Runs of rows whose terms come to about ``most``."""
    block: list = []
    held = 0
    for row in rows:
        n = len(terms(row["text"]))
        if block and held + n > most:
            yield block
            block, held = [], 0
        block.append(row)
        held += n
    if block:
        yield block
