"""Folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands in for ``spark.checkpoint.dir`` where all of Spark runs in one process.
LOCAL_DIR = "shellac.shared.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, one temporary folder a session on a single machine, an
    error on a cluster.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(LOCAL_DIR, None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shellac-")
        spark.conf.set(LOCAL_DIR, found)
    return found.rstrip("/")


#: Sides of joins are broadcast up to this many rows, else joined by a shuffle.
BROADCAST_ROWS = 500_000


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side whose rows were counted, if they are few; else it is never broadcast.

    Spark's own estimate goes by the size of packed files: a few columns of a wide
    table look small, however many rows they have.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back."""
    path = workspace(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def removed(df: DataFrame) -> None:
    """Delete a table of ``stored`` that nothing reads any more."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
