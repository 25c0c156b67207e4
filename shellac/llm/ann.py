"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Vectors are lifted by one component to a common length, so that the order of
inner products is the order of distances.  Each of several tables cuts Gaussian
projections into slots; a bucket is a tuple of slots.  A query visits buckets in
the order of their estimated success: the sum over the projections of the squared
distance from the query to the slot.  It stops at a bound on that sum, which is
fitted on a bounded sample of queries with their exact neighbours, so that the
recall aimed at holds whatever the data.  Candidates of all tables are merged by
their exact inner products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Vectors in one chunk of a bucket, and queries in one block of those that visit it: more of them are split.
CHUNK = 4096


class Tables:
    """The hash functions: ``count`` tables of ``size`` projections with slots of one width."""

    def __init__(self, dims: int, longest: float, n: int, count: int, per_bucket: int, seed: int):
        # a Gaussian projection in slots of one deviation tells about two bits
        self.size = max(1, round(math.log2(max(2.0, n / per_bucket)) / 2))
        self.count, self.longest = count, longest or 1.0
        r = np.random.default_rng(seed)
        self.a = r.normal(0, 1, (dims + 1, count * self.size))
        self.b = r.uniform(0, 1, count * self.size)

    def places(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Places on the slot lines, (rows, tables, projections)."""
        x = x / self.longest
        length = (x * x).sum(1)
        if query:
            x = x / np.sqrt(length)[:, None]
            last = np.zeros(len(x))
        else:
            last = np.sqrt(np.maximum(0.0, 1 - length))
        return (np.c_[x, last] @ self.a + self.b).reshape(len(x), self.count, self.size)

    @staticmethod
    def cost(place: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Squared distance from the places to the slots, summed over the projections."""
        gap = np.maximum(0.0, np.maximum(slots - place, place - slots - 1))
        return (gap * gap).sum(-1)

    def probes(self, place: np.ndarray, bound: float) -> np.ndarray:
        """All slot tuples within ``bound`` of one query's place in one table, in order of success."""
        slots, cost = np.zeros((1, 0), np.int64), np.zeros(1)
        reach = math.sqrt(bound)
        for x in place:
            options = np.arange(math.floor(x - reach), math.floor(x + reach) + 1)
            gap = np.maximum(0.0, np.maximum(options - x, x - options - 1)) ** 2
            total = cost[:, None] + gap
            i, j = np.nonzero(total <= bound)
            slots, cost = np.c_[slots[i], options[j]], total[i, j]
        return slots[np.argsort(cost, kind="stable")]

    def keys(self, slots: np.ndarray, table: int) -> np.ndarray:
        """One long for each slot tuple of a table."""
        h = np.full(len(slots), (table + 1) * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for k in range(slots.shape[1]):
            h = (h ^ slots[:, k].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return (h * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def _matrix(vectors) -> np.ndarray:
    return np.array(list(vectors), np.float64)


def search(
    vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.955,
    tables: int = 3, per_bucket: int = 512, fitted_on: int = 160, seed: int = 17,
) -> DataFrame:
    """The ``k`` nearest of each query: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``.

    Queries are the rows where the column ``is_query`` holds, candidates all
    other rows.  Null ids, and vectors that are null, zero, of another length
    than most or hold null or non-finite components take no part.  Equal vectors
    are searched once: of each the least ``k + 1`` ids can be found.  Ties go to
    the smaller id.  Rows that repeat an id and vector count once; an id that
    stands on rows with different vectors keeps the least of them (compared
    component by component) and asks if any of its rows does.  An empty table
    gives no row, further columns are not read.  ``recall`` is aimed at on a
    sample of about ``fitted_on`` queries; all rows are indexed.
    """
    v = F.col(vector_col).cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sizes is None:
        return empty
    rows = rows.filter(F.size("v") == sizes["d"])

    # an id on rows with different vectors keeps the least of them
    told = rows.groupBy("id").agg(F.min(F.xxhash64("v")).alias("x"), F.max(F.xxhash64("v")).alias("y")).filter("x <> y").select("id")
    if told.limit(1).count():
        several = written(told, "several")
        least_vector = rows.join(several, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v"), F.max("asks").alias("asks"))
        rows = rows.join(several, "id", "left_anti").unionByName(least_vector)

    # classes of equal vectors; the salt pre-aggregates a class of a third of all rows
    least = F.slice(F.array_sort(F.collect_set("id")), 1, k + 1)
    salted = rows.groupBy("v", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).agg(least.alias("ids"))
    classes = salted.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    classes = written(classes.select(F.col("ids")[0].alias("c"), "v", "ids"), "classes")
    asking = written(rows.filter("asks").select("id", "v").distinct().join(classes.select("c", "v"), "v").select("id", "c"), "asking")
    about = classes.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m")).first()
    if not about["n"]:
        return empty
    made = Tables(sizes["d"], math.sqrt(about["m"]), about["n"], tables, per_bucket, seed)
    queries = classes.join(asking.select("c").distinct(), "c", "left_semi").select("c", "v")
    bound = _fit(classes, queries, made, k, recall, fitted_on)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                slots = np.floor(made.places(_matrix(pdf["v"]), False)).astype(np.int64)
                for t in range(made.count):
                    yield pd.DataFrame({"bucket": made.keys(slots[:, t], t), "c": pdf["c"], "v": pdf["v"]})

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 200):
                part = pdf.iloc[at : at + 200]
                where = made.places(_matrix(part["v"]), True)
                got = [np.concatenate([made.keys(made.probes(w[t], bound), t) for t in range(made.count)]) for w in where]
                yield pd.DataFrame({"c": part["c"].to_numpy(), "v": part["v"].to_numpy(), "buckets": got})

    placed = written(classes.select("c", "v").mapInPandas(place, "bucket long, c long, v array<double>"), "placed")
    visits = written(queries.mapInPandas(visit, "c long, v array<double>, buckets array<long>"), "visits")
    pieces = F.ceil(F.col("count") / CHUNK).cast("int")
    chunks = placed.groupBy("bucket").count().select("bucket", pieces.alias("chunks"))
    blocks = visits.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().select("bucket", pieces.alias("blocks"))
    directory = written(chunks.join(blocks, "bucket"), "directory")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in its own piece of the bucket, once for each piece of the other side."""
        mine, theirs = F.pmod(F.xxhash64("c"), F.col(f"{own}s")).cast("int"), F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))
        return rows.join(directory, "bucket").select("bucket", mine.alias(own), theirs.alias(other), "c", "v")

    held = dealt(placed, "chunk", "block")
    probed = dealt(visits.select("c", "v", F.explode("buckets").alias("bucket")), "block", "chunk")

    def rank(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"q": [], "n": [], "c": []}, dtype=object)
        x, ids = _matrix(b["v"]), b["c"].to_numpy()
        q, scores, found = [], [], []
        for at in range(0, len(a), 256):
            part = a.iloc[at : at + 256]
            s = _matrix(part["v"]) @ x.T
            for row, c in zip(s, part["c"], strict=True):
                best = np.arange(len(ids))
                if len(best) > k + 1:
                    best = np.flatnonzero(row >= np.partition(row, -(k + 1))[-(k + 1)])
                best = best[np.lexsort((ids[best], -row[best]))][: k + 1]
                q.append(c)
                scores.append(-row[best])
                found.append(ids[best])
        return pd.DataFrame({"q": q, "n": scores, "c": found})

    each = probed.groupBy("bucket", "chunk", "block").cogroup(held.groupBy("bucket", "chunk", "block")).applyInPandas(rank, "q long, n array<double>, c array<long>")
    # a candidate comes from each table once at most: so many entries hold the best of all tables;
    # the lists of a query meet in parts first, so that no row holds those of all its probes
    def merged(lists):
        return F.slice(F.sort_array(F.flatten(F.collect_list(lists))), 1, (k + 1) * made.count).alias("f")

    parts = each.groupBy("q", F.pmod(F.xxhash64("c"), F.lit(16)).alias("part")).agg(merged(F.arrays_zip("n", "c")))
    near = parts.groupBy("q").agg(merged(F.col("f"))).select("q", F.explode("f").alias("f")).select("q", (-F.col("f.n")).alias("s"), F.col("f.c").alias("c")).groupBy("q", "c").agg(F.max("s").alias("s"))
    top = Window.partitionBy("q").orderBy(F.desc("s"), "c")
    best = near.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= k + 1).drop("r")
    named = best.join(classes.select("c", "ids"), "c").select("q", "s", F.explode("ids").alias("vec_id"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = named.join(asking.select(F.col("id").alias("query_id"), F.col("c").alias("q")), "q").filter("query_id <> vec_id")
    out = out.select("query_id", F.col("vec_id"), F.col("s").alias("score")).withColumn("rank", F.row_number().over(final))
    return out.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _fit(classes: DataFrame, queries: DataFrame, made: Tables, k: int, recall: float, fitted_on: int) -> float:
    """The bound on the cost at which the sampled queries find the share ``recall`` of their exact neighbours.

    The exact neighbours come from one pass over all vectors, in which each
    batch keeps its best for each sampled query.
    """
    n = queries.count()
    if not n:
        return 0.0
    share = int(min(1.0, fitted_on / n) * (1 << 30))
    sample = queries.filter(F.pmod(F.xxhash64("c", F.lit(5)), F.lit(1 << 30)) <= share).limit(2 * fitted_on).collect()
    if not sample:
        sample = queries.limit(1).collect()
    ids, q = np.array([r["c"] for r in sample]), _matrix(r["v"] for r in sample)
    where = made.places(q, True)

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = _matrix(pdf["v"])
            slots = np.floor(made.places(x, False))
            s = q @ x.T
            s[ids[:, None] == pdf["c"].to_numpy()[None]] = -np.inf
            best = np.argsort(-s, 1, kind="stable")[:, :k]
            cost = np.stack([made.cost(where[i][None], slots[best[i]]).min(1) for i in range(len(q))])
            yield pd.DataFrame({"q": np.repeat(np.arange(len(q)), best.shape[1]), "s": np.take_along_axis(s, best, 1).reshape(-1), "cost": cost.reshape(-1)})

    got = classes.select("c", "v").mapInPandas(exact, "q int, s double, cost double")
    top = Window.partitionBy("q").orderBy(F.desc("s"))
    costs = [r["cost"] for r in got.withColumn("r", F.row_number().over(top)).filter((F.col("r") <= k) & (F.col("s") > float("-inf"))).select("cost").collect()]
    if not costs:
        return 0.0
    # with as few vectors as are asked for, every one of them is to be found
    few = classes.limit(k + 2).count() <= k + 1
    return float(np.quantile(costs, 1.0 if few else recall, method="higher")) + 1e-9
