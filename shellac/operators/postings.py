"""A stored index of substring pieces, kept up to date by the diff of an import.

A row of the index holds the ids of one block of the id space whose text has a
piece of six signs, or of three for shorter terms.  Blocks bound the lists, whatever a piece's frequency, and
are what an update rewrites: an import's inserted and deleted rows name the blocks
they lie in, and all other files go on into the next generation.  A generation is
its manifest: which folder holds each block.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import SHORT_PIECE, SUBSTRING_TEXT, pieces, with_search_text

#: Signs of a piece, for short terms and for others.
SIZES = (SHORT_PIECE, 6)
#: Ids of a block, and entries that a task holds before it sends them on.
BLOCK_IDS, HELD = 1 << 16, 2_000_000
#: A block's lists lie in so many files at most.
FILES = 1


def postings(cat: DataFrame, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The index of some rows: ``block``, ``piece``, ``ids`` (ascending).

    Pieces reach over no two fields; rows without text have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, str], list[int]] = defaultdict(list)
        held = 0

        def sent() -> pa.RecordBatch:
            keys, lists = list(found), list(found.values())
            return pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in keys], pa.int64()), pa.array([p for _, p in keys], pa.string()), pa.array(lists, pa.list_(pa.int64()))], names=["block", "piece", "ids"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block, own = i // block_ids, {text[k : k + n] for n in SIZES for k in range(len(text) - n + 1)}
                for piece in own:
                    if "\u0001" not in piece:
                        found[block, piece].append(i)
                held += len(own)
            if held >= HELD:
                yield sent()
                found.clear()
                held = 0
        if found:
            yield sent()

    rows = with_search_text(cat).select("id", F.col(SUBSTRING_TEXT).alias("text")).filter("id is not null and length(text) > 0")
    parts = rows.mapInArrow(run, "block long, piece string, ids array<long>")
    return parts.groupBy("block", "piece").agg(F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"))


def _written(index: DataFrame, root: str) -> DataFrame:
    """Write blocks to a folder of their own; the manifest of these blocks: ``block``, ``folder``."""
    folder = f"{root}/blocks-{uuid.uuid4().hex}"
    index.repartition("block", F.pmod(F.xxhash64("piece"), F.lit(FILES))).sortWithinPartitions("block", "piece").write.partitionBy("block").parquet(folder)
    return _blocks_of(index.sparkSession, folder).select("block", F.lit(folder).alias("folder")).distinct()


def _blocks_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("block long, piece string, ids array<long>").parquet(folder)


def publish_postings(cat: DataFrame, root: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Build the index of a catalogue below a folder; returns its manifest, a row a block."""
    return _saved(_written(postings(cat, block_ids), root), root)


def _saved(manifest: DataFrame, root: str) -> DataFrame:
    path = f"{root}/manifest-{uuid.uuid4().hex}"
    manifest.write.parquet(path)
    return manifest.sparkSession.read.schema("block long, folder string").parquet(path)


def read_postings(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The index that a manifest names: of every folder the blocks that are still its own."""
    held = manifest.groupBy("folder").agg(F.collect_set("block").alias("blocks")).collect()  # a row a generation
    parts = [_blocks_of(spark, r["folder"]).filter(F.col("block").isin(r["blocks"])).select("block", "piece", "ids") for r in held]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "block long, piece string, ids array<long>")


def update_postings(manifest: DataFrame, deleted: DataFrame, inserted: DataFrame, root: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The manifest after an import: rows that went, and rows that came, both with their fields.

    Only the blocks of these rows are read and written again; a block that loses
    its last list leaves the manifest.
    """
    spark = manifest.sparkSession
    touched = deleted.select("id").unionByName(inserted.select("id")).select(F.floor(F.col("id") / block_ids).cast("long").alias("block")).distinct()
    blocks = [r["block"] for r in touched.collect()]  # ids of blocks, as few as the manifest has rows
    old = read_postings(spark, manifest.filter(F.col("block").isin(blocks)))
    gone, come = postings(deleted, block_ids).withColumnRenamed("ids", "gone"), postings(inserted, block_ids).withColumnRenamed("ids", "come")
    none = F.array().cast("array<long>")
    changes = gone.join(come, ["block", "piece"], "full_outer")
    both = old.join(changes, ["block", "piece"], "full_outer")
    left = F.array_except(F.coalesce("ids", none), F.coalesce("gone", none))
    merged = both.select("block", "piece", F.when(F.col("gone").isNull() & F.col("come").isNull(), F.col("ids")).otherwise(F.array_sort(F.array_union(left, F.coalesce("come", none)))).alias("ids")).filter(F.size("ids") > 0)
    kept = manifest.filter(~F.col("block").isin(blocks))
    return _saved(kept.unionByName(_written(merged, root)), root)


#: Pieces of a term whose lists are intersected: so many of the rarest.
INTERSECTED = 2


def candidates(index: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows that may hold each ``term``: ``term``, ``id``; those in the lists of its rarest pieces.

    Terms have three signs or more.  Only lists of wanted pieces are read on; a
    term meets its lists block by block.
    """
    short, long = (pieces(F.col("term"), n) for n in SIZES)
    each = terms.select("term", F.explode(F.when(F.length("term") < SIZES[1], short).otherwise(long)).alias("piece"))
    wanted = each.select("piece").distinct()
    lists = index.join(F.broadcast(wanted) if wanted.limit(200_001).count() <= 200_000 else wanted, "piece", "left_semi")
    counts = lists.groupBy("piece").agg(F.sum(F.size("ids")).alias("n"))
    # a piece that no row holds has no list, and its term no row
    ranked = each.join(counts, "piece", "left").groupBy("term").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece"))), 1, INTERSECTED).alias("best"))
    best = ranked.filter("best[0].n > 0").select("term", F.size("best").alias("k"), F.explode("best.piece").alias("piece"))
    met = lists.join(best, "piece").groupBy("term", "k", "block").agg(F.collect_list("ids").alias("lists")).filter("size(lists) = k")
    common = F.aggregate(F.slice("lists", 2, INTERSECTED), F.element_at("lists", 1), lambda a, b: F.array_intersect(a, b))
    return met.select("term", F.explode(common).alias("id"))
