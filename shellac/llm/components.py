"""Connected components in DataFrames, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours of each node v on the least of v and its neighbours: those above v (large) or up to it (small).

    The least comes from an aggregate, which Spark sums up before the shuffle, and
    a join back, which it splits: the centre of a large component is no task's load.
    """
    flipped = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    around = edges.unionByName(flipped) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    hung = around.filter("b > a").join(least, "a") if large else around.join(least, "a")
    if large:
        out = hung.select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        both = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        out = hung.select(F.explode(both).alias("e")).select("e.a", "e.b")
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Nodes of ``edges`` (a, b: long) with the least node of their component: ``id``, ``component``.

    Each round is written to the shared folder and the one before it deleted; the
    number of rounds grows with the logarithm of the longest path.  Nodes without
    edges don't appear; null ends are left out.  The result stands on a written
    table, ``written_to``.
    """
    now = written(edges.select("a", "b").dropna().filter("a <> b").distinct(), "edges")
    last = None
    while True:
        then, now = now, written(_star(_star(now, True), False), "edges")
        dropped(then)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == last or state[0] == 0:
            break
        last = state
    leaves = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = written(leaves.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()), "components")
    dropped(now)
    return out
