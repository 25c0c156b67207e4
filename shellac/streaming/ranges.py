"""A request limiter replayed over ranges of events, so that a hot key is walked by many tasks.

What the events of a range do to a window is a step function: from the end of
the window that is open where the range begins to that of the one open where it
ends.  The functions of a key's ranges are put together by doubling, after which
each range knows the window it begins in and is walked by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import removed, stored
from . import request_limiter, walked

STEPS = "upto array<long>, x array<long>, p array<long>"
#: The bound of a step that holds wherever the window ends.
EVER = 1 << 62


def distinct_steps(upto: np.ndarray, x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring steps of one outcome become one."""
    last = np.ones(len(upto), bool)
    last[:-1] = (x[1:] != x[:-1]) | (p[1:] != p[:-1])
    return upto[last], x[last], p[last]


def steps(ms: np.ndarray, window_ms: int, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The function of a run of sorted times as (upto, x, p).

    A window that ends before ``upto`` (and not before the step's predecessor) is
    followed by others, of which the last ends at ``x`` and starts with the key's
    event number ``p``; one that ends later is still open behind the run.
    """
    after = np.searchsorted(ms, ms + window_ms, "right")
    at = np.where(after < len(ms), after, np.arange(len(ms)))
    while (further := at[at]).tolist() != at.tolist():
        at = further
    first = np.ones(len(ms), bool)
    first[1:] = ms[1:] != ms[:-1]  # a window never starts between equal times
    at = at[first]
    return distinct_steps(ms[first], ms[at] + window_ms, at + offset)


def composed(f: tuple, g: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First ``f``, then ``g``."""
    (fu, fx, fp), (gu, gx, gp) = f, g
    at = np.searchsorted(gu, fx, "right")
    open_ = at == len(gu)
    at = np.minimum(at, len(gu) - 1)
    beyond = gu > fu[-1]
    return distinct_steps(np.r_[fu, gu[beyond]], np.r_[np.where(open_, fx, gx[at]), gx[beyond]], np.r_[np.where(open_, fp, gp[at]), gp[beyond]])


def replay_limiter(events: DataFrame, key: str, order: str, limit: int = 150, window_ms: int = 60_000) -> DataFrame:
    """``replay`` of the request limiter, in which the events of one key lie in as many tasks as they fill.

    Events are dealt by ranges of (key, ms, order).  Only keys that go on over a
    range's border need pointers, one row a range; of them a task holds the times
    of one range.  A step function has no more steps than the range has events,
    nor than a window has milliseconds.  Null keys are one key, repeated rows
    count each by itself, an empty table gives no row.
    """
    guard = request_limiter(limit, window_ms)
    by = [key, "ms", order]
    dealt = stored(events.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_range", F.spark_partition_id()), "dealt")
    runs = dealt.groupBy(key, "_range").agg(F.count("*").alias("n"))
    wide = runs.groupBy(key).agg(F.min("_range").alias("first"), F.max("_range").alias("last")).filter("first < last").select(F.col(key).alias("_key"), "first", "last")
    wide = stored(wide, "wide_keys")  # no more keys than borders; ``first`` names the key
    inside = dealt[key].eqNullSafe(F.col("_key")) & F.col("_range").between(F.col("first"), F.col("last"))
    own = dealt.join(F.broadcast(wide), inside).select("first", "_range", "ms")
    upto = Window.partitionBy("first").orderBy("_range")
    placed = own.groupBy("first", "_range").agg(F.count("*").alias("n")).select("first", "_range", (F.row_number().over(upto) - 1).alias("j"), (F.sum("n").over(upto) - F.col("n")).alias("offset"))
    placed = stored(placed, "runs")
    rounds = (placed.agg(F.max("j")).first()[0] or 0).bit_length()

    def made(pdf: pd.DataFrame) -> pd.DataFrame:
        j, offset = pdf["j"].iloc[0], int(pdf["offset"].iloc[0])
        u, x, p = steps(np.sort(pdf["ms"].to_numpy(np.int64)), window_ms, offset)
        if j == 0:  # no window is open where the key begins
            u, x, p = np.array([EVER]), x[:1], p[:1]
        return pd.DataFrame({"first": [pdf["first"].iloc[0]], "j": [j], "upto": [u], "x": [x], "p": [p]})

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                g = (r.upto, r.x, r.p)
                out.append(g if r.upto0 is None else composed((r.upto0, r.x0, r.p0), g))
            yield pd.DataFrame({"first": pdf["first"], "j": pdf["j"], **{n: [o[i] for o in out] for i, n in enumerate(("upto", "x", "p"))}})

    now = stored(own.join(F.broadcast(placed), ["first", "_range"]).groupBy("first", "_range").applyInPandas(made, f"first int, j int, {STEPS}"), "steps")
    for k in range(rounds):
        before = now.select("first", (F.col("j") + (1 << k)).alias("j"), *(F.col(c).alias(f"{c}0") for c in ("upto", "x", "p")))
        was, now = now, stored(now.join(before, ["first", "j"], "left").mapInPandas(joined, f"first int, j int, {STEPS}"), "steps")
        removed(was)

    # what is open where each run begins; one row a range: the bound of this broadcast
    open_ = now.select("first", (F.col("j") + 1).alias("j"), F.col("x")[0].alias("x"), F.col("p")[0].alias("p"))
    entry = placed.join(open_, ["first", "j"]).join(wide, "first").select("_key", F.col("_range").alias("_at"), (F.col("x") - window_ms).alias("_start"), (F.col("offset") - F.col("p")).alias("_held"))
    begun = dealt.join(F.broadcast(entry), dealt[key].eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_at")), "left")
    rows = begun.select(*dealt.columns, "_start", "_held").repartition("_range").sortWithinPartitions("_range", *by)
    return walked(rows, guard, ["_range", key], ["_start", "_held"])
