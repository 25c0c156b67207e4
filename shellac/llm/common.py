"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..storage import shared_dir


#: Spark's own switch that removes an execution's shuffle files as soon as it has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.  The
    shuffle files behind ``df`` go once it is written; ``dropped`` removes the
    table when what was made of it is written in turn.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more; other frames are left alone."""
    for df in tables:
        path = getattr(df, "written_to", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


_OWNER: list[str | None] = [None]
_RELEASE: list = []


def on_release(free) -> None:
    """Register what drops an operator's memos and tokenizers from a Python worker."""
    _RELEASE.append(free)


def take_worker(owner: str) -> None:
    """Called where an operator starts in a worker: what others have left there goes.

    Spark hands the same workers to all stages of a job; without this their
    memos would add up.
    """
    if _OWNER[0] == owner:
        return
    if _OWNER[0] is not None:
        for free in _RELEASE:
            free()
        rest_worker()
    _OWNER[0] = owner


def rest_worker() -> None:
    """Called where a task has sent its last batch: pages that neither Python nor Arrow uses go back.

    A worker that waits for its next task stands beside the executor's heap, which
    may be full by then.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library: it keeps the pages for later use
        pass


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession, rows: int = 500) -> None:
    """Lower the rows of an Arrow batch: texts are long, and a worker holds a batch several times over."""
    now = int(spark.conf.get(ARROW_ROWS))
    if now <= 0 or now > rows:
        spark.conf.set(ARROW_ROWS, str(rows))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_size(items: list, sizes: Iterable[int], most: int) -> Iterator[list]:
    """Cut ``items`` into runs whose sizes add up to about ``most`` at most."""
    run: list = []
    held = 0
    for item, size in zip(items, sizes, strict=True):
        if run and held + size > most:
            yield run
            run, held = [], 0
        run.append(item)
        held += size
    if run:
        yield run


class Memo(dict):
    """A bounded memo of per-string results, of two generations.

    ``fill(words)`` computes what is missing.  When the young generation is
    full it becomes the old one, and entries still in use move back: frequent
    strings stay.  A generation holds ``most`` entries at most whose strings and
    results come to ``most_bytes``; a string of more than a 256th of that is
    computed and kept for the present call only.
    """

    def __init__(self, compute, most: int = 400_000, most_bytes: int = 48 << 20):
        super().__init__()
        self.compute, self.most, self.most_bytes, self.old, self.held = compute, most, most_bytes, {}, 0
        self.passing: list[str] = []

    def fill(self, words: Iterable[str]) -> None:
        for w in self.passing:
            self.pop(w, None)
        self.passing = []
        words = words if isinstance(words, set) else set(words)
        missing = {w for w in words if w not in self}
        if not missing:
            return
        if len(self) + len(missing) > self.most or self.held > self.most_bytes:
            self.old, self.held = dict(self), 0
            self.clear()
            missing = words
        unknown = list(missing.difference(self.old))
        known = missing.difference(unknown)
        self.update((w, self.old[w]) for w in known)
        self.held += 2 * sum(map(len, known))
        if unknown:
            got = self.compute(unknown)
            self.update(zip(unknown, got, strict=True))
            sized = hasattr(got[0], "__len__")
            self.held += sum(map(len, unknown)) + (sum(map(len, got)) if sized else 8 * len(got))
            most = self.most_bytes >> 8
            if max(map(len, unknown)) > most >> 4:
                long = [(w, len(w) + (len(x) if sized else 8)) for w, x in zip(unknown, got, strict=True)]
                self.passing = [w for w, n in long if n > most]
                self.held -= sum(n for _, n in long if n > most)
