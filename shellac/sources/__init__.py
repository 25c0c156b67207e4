"""Reading, writing and publishing the catalogue."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import null_if_blank
from ..operators.diff import dense_numbers
from ..schema import EDITABLE_FIELDS, FACETS, HEADERS, SOURCE_FIELDS
from ..storage import removed
from .quoted_lines import read_records, values_span

SPARE = 8


def detect_encoding(spark: SparkSession, path: str) -> DataFrame:
    """(file, encoding) of each file: UTF-8 if all of it decodes, else Windows-1252; one row per file leaves the executors.

    Files are read as lines, in splits, so that no file is held whole: a file is
    UTF-8 if all of its lines are, for a line end is no part of another sign.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("valid"))
    judged = lines.groupBy("file").agg(F.bool_and("valid").alias("valid"))
    encoding = F.when(F.coalesce("valid", F.lit(True)), "UTF-8").otherwise("windows-1252")
    return files.join(judged, "file", "left").select("file", encoding.alias("encoding"))


def read_catalogue_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """The 24 source columns by position, with the file order ``n``.

    The header is skipped; short and long rows are tolerated, quoted values may
    span lines, blank values are null, blank rows go.  A byte order mark stands
    in the header and goes with it.  Files are read in splits, in any encoding of
    Python's: by Spark's own reader where no value spans lines and Spark knows the
    encoding, else line by line (``quoted_lines``).  But for UTF-16 and UTF-32,
    whose line ends are several bytes: each of these files takes one task.
    """
    behind = []
    names = [*SOURCE_FIELDS, *(f"_spare{i}" for i in range(SPARE))]
    schema, options = ", ".join(f"{c} string" for c in names), {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    wide = encoding.upper().startswith(("UTF-16", "UTF-32"))
    if wide or encoding.upper() in ("UTF-8", "US-ASCII", "ISO-8859-1") and not values_span(spark, path):
        read = spark.read.csv(path, schema=schema, header=True, enforceSchema=True, multiLine=wide, encoding=encoding, **options)
        rows = read.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
    else:
        records, behind = read_records(spark, path, encoding)
        rows = records.select(F.from_csv("value", schema, options | {"multiLine": "true"}).alias("row"), "file", "block", "i").select("row.*", "file", "block", "i")
    kept = rows.select(*(null_if_blank(c).alias(c) for c in SOURCE_FIELDS), F.struct("file", "block", "i").alias("_at")).dropna(how="all", subset=SOURCE_FIELDS)
    numbered = dense_numbers(kept, "_at", "n").drop("_at")
    for table in behind:
        removed(table)
    return numbered


def export_catalogue(cat: DataFrame, path: str) -> None:
    """CSV of the source columns under their headers, in order of the id; it can be imported again."""
    cat.orderBy("id").select(*(F.col(f).alias(h) for f, h in zip(SOURCE_FIELDS, HEADERS, strict=True))).write.csv(path, header=True, quote='"', escape='"', emptyValue="")


class Generations:
    """Published generations under one folder: Parquet per generation and a pointer to the live and the previous one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def pointer(self) -> dict:
        at = self._path(f"{self.root}/pointer.json")
        if not self._fs.exists(at):
            return {"live": None, "previous": None, "updated_at": None}
        stream = self._fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _point(self, live, previous, updated_at: str) -> None:
        part, at = self._path(f"{self.root}/.pointer-{uuid.uuid4().hex}"), self._path(f"{self.root}/pointer.json")
        out = self._fs.create(part, True)
        out.write(json.dumps({"live": live, "previous": previous, "updated_at": updated_at}).encode())
        out.close()
        # in one step, so that there is a live generation at every moment
        jvm = self.spark._jvm
        overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(part).toUri(), self.spark._jsc.hadoopConfiguration())
        files.rename(self._fs.makeQualified(part), self._fs.makeQualified(at), overwrite)

    def _claim(self, number: int) -> int:
        """The first number from the given one on that no other publisher has taken; it is taken by creating its file."""
        while True:
            at = self._path(f"{self.root}/.claim-{number}")
            try:
                self._fs.create(at, False).close()
                return number
            except Py4JJavaError:
                if not self._fs.exists(at):
                    raise
                number += 1

    def publish(self, df: DataFrame, updated_at: str) -> int:
        """Write a new generation aside, then make it the live one.

        Publishers at the same time write under different numbers; the one that
        ends last is live.
        """
        old = self.pointer()
        number = self._claim(max(old["live"] or 0, old["previous"] or 0) + 1)
        df.write.mode("overwrite").parquet(f"{self.root}/gen={number}")
        self._point(number, self.pointer()["live"], updated_at)
        return number

    def restore_previous(self, updated_at: str) -> None:
        """Exchange the live and the previous generation; doing it twice undoes it."""
        old = self.pointer()
        if old["previous"] is None:
            raise ValueError("there is no previous generation")
        self._point(old["previous"], old["live"], updated_at)

    def read(self, which: str = "live") -> DataFrame:
        number = self.pointer()[which]
        if number is None:
            raise ValueError(f"there is no {which} generation")
        return self.spark.read.parquet(f"{self.root}/gen={number}")

    def status(self) -> DataFrame:
        """One row: ``has_live``, ``n_rows``, ``updated_at``, ``has_previous``."""
        now = self.pointer()
        counted = self.read().agg(F.count("*").alias("n_rows")) if now["live"] is not None else self.spark.range(1).select(F.lit(0).cast("long").alias("n_rows"))
        return counted.select(F.lit(now["live"] is not None).alias("has_live"), "n_rows", F.lit(now["updated_at"]).cast("string").alias("updated_at"), F.lit(now["previous"] is not None).alias("has_previous"))


def row_count_gate(new: DataFrame, previous: DataFrame) -> DataFrame:
    """One row: both counts, and ``warn`` if the new one is under half of a known previous one."""
    a, b = new.agg(F.count("*").alias("new_count")), previous.agg(F.count("*").alias("previous_count"))
    return a.crossJoin(b).withColumn("warn", (F.col("previous_count") > 0) & (2 * F.col("new_count") < F.col("previous_count")))


#: Pages besides the records, in the first chunk (fixed values).
STATIC_PAGES = ["/", "/advanced-search", "/guide", "/interviews", "/history", "/contact", *(f"/browse/{f}" for f in FACETS)]


def sitemap_chunks(cat: DataFrame, per: int = 45_000) -> DataFrame:
    """Addresses in chunks of ``per`` records by id: ``chunk``, ``pos``, ``path``; chunk 0 leads with the other pages."""
    numbered = dense_numbers(cat.select("id"), "id", "pos")
    records = numbered.select(F.floor((F.col("pos") - 1) / per).cast("long").alias("chunk"), "pos", F.concat(F.lit("/records/"), F.col("id").cast("string")).alias("path"))
    pages = cat.sparkSession.createDataFrame([(0, i - len(STATIC_PAGES), p) for i, p in enumerate(STATIC_PAGES)], "chunk long, pos long, path string")
    return pages.unionByName(records)


def sitemap_index(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chunk").agg(F.count("*").alias("n"))


def added_data(data: Column) -> dict[str, Column]:
    """The editable columns in an added row's JSON; what can't be read counts as empty."""
    got = F.coalesce(F.from_json(data, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return {f: got[f] for f in EDITABLE_FIELDS}


def read_overlay(spark: SparkSession, overrides: str, added: str, tombstones: str) -> dict[str, DataFrame]:
    """The overlay's three tables from Parquet; added rows with their data as columns, tombstones as keys."""
    rows = spark.read.parquet(added)
    return {"overrides": spark.read.parquet(overrides), "added": rows.withColumns(added_data(F.col("data"))), "tombstones": spark.read.parquet(tombstones).select("record_key").distinct()}
