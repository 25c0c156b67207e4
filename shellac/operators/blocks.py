"""A stored catalogue in blocks of ids, of which a change writes only those it touches.

A block's rows lie in one file, so a block bounds what a task sorts and what the
edit of a single row costs.  A generation is its manifest: which folder holds each
block.  A change reads the blocks that the ids in question lie in, writes them to a
folder of their own, and names all other files again.  Older manifests stay
readable; ``Generations`` publishes a manifest like any other table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import sized, stored
from . import overlay

#: Ids of a block.
BLOCK_IDS = 1 << 18
MANIFEST = "block long, folder string"

Changed = tuple["Blocks", dict[str, DataFrame]]


class Blocks:
    """A catalogue as a manifest names it; every change gives a new one and the other tables that it changed."""

    def __init__(self, manifest: DataFrame, schema: StructType, root: str, block_ids: int = BLOCK_IDS):
        self.manifest, self.schema, self.root, self.block_ids = manifest, schema, root.rstrip("/"), block_ids
        self.spark: SparkSession = manifest.sparkSession

    @classmethod
    def publish(cls, cat: DataFrame, root: str, block_ids: int = BLOCK_IDS) -> Blocks:
        """Write a whole catalogue below a folder."""
        none = cls(cat.sparkSession.createDataFrame([], MANIFEST), cat.schema, root, block_ids)
        return none._with(none.manifest, cat)

    def _block(self, id_: str = "id") -> Column:
        return F.floor(F.col(id_) / self.block_ids).cast("long")

    def _with(self, kept: DataFrame, cat: DataFrame) -> Blocks:
        """The blocks that are kept, and those of some rows, which are written."""
        folder = f"{self.root}/blocks-{uuid.uuid4().hex}"
        cat.withColumn("_block", self._block()).repartition("_block").sortWithinPartitions("_block", "id").write.partitionBy("_block").parquet(folder)
        data = self.spark.read.schema(StructType([*self.schema]).add("_block", "long")).parquet(folder)
        path = f"{self.root}/manifest-{uuid.uuid4().hex}"
        kept.select("block", "folder").unionByName(data.select(F.col("_block").alias("block"), F.lit(folder).alias("folder")).distinct()).write.parquet(path)
        return Blocks(self.spark.read.schema(MANIFEST).parquet(path), self.schema, self.root, self.block_ids)

    def read(self, manifest: DataFrame | None = None) -> DataFrame:
        """The rows of all blocks, or of those in a part of the manifest; one scan, the driver gets a path a block."""
        rows = (self.manifest if manifest is None else manifest).collect()
        paths = sorted(f"{r['folder']}/_block={r['block']}" for r in rows)
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def changed(self, blocks: DataFrame, change: Callable[[DataFrame], dict[str, DataFrame]]) -> Changed:
        """Apply a change of the tables to the given blocks alone: ``cat`` is written, what else it returns is passed on.

        A block that loses its last row leaves the manifest; rows that come may lie
        in new blocks.  Nothing is written where no block is touched and none comes.
        """
        touched = sized(stored(blocks.select("block").distinct(), "touched"))
        tables = change(self.read(self.manifest.join(touched, "block", "left_semi")))
        return self._with(self.manifest.join(touched, "block", "left_anti"), tables.pop("cat")), tables

    def _of(self, ids: DataFrame, id_: str) -> DataFrame:
        return ids.select(self._block(id_).alias("block"))

    def apply_edits(self, overrides: DataFrame, added: DataFrame, log: DataFrame, batch: DataFrame, now) -> Changed:
        """As :func:`overlay.apply_edits`."""
        return self.changed(self._of(batch, "record_id"), lambda cat: overlay.apply_edits(cat, overrides, added, log, batch, now))

    def apply_category_fix(self, overrides: DataFrame, added: DataFrame, log: DataFrame, fixes: DataFrame, editor: str, now) -> Changed:
        """As :func:`overlay.apply_category_fix`; the columns of the fixes are read of all blocks."""
        return self.apply_edits(overrides, added, log, stored(overlay.category_edits(self.read(), fixes, editor), "edits"), now)

    def create_records(self, added: DataFrame, log: DataFrame, rows: DataFrame, editor: str, now) -> Changed:
        """As :func:`overlay.create_records`; the last block holds the highest id."""
        last = self.manifest.agg(F.max("block").alias("block")).dropna()
        return self.changed(last, lambda cat: overlay.create_records(cat, added, log, rows, editor, now))

    def delete_records(self, overrides: DataFrame, added: DataFrame, tombstones: DataFrame, log: DataFrame, ids: DataFrame, editor: str, now) -> Changed:
        """As :func:`overlay.delete_records`."""
        return self.changed(self._of(ids, "id"), lambda cat: overlay.delete_records(cat, overrides, added, tombstones, log, ids, editor, now))

    def remove_overrides(self, overrides: DataFrame, log: DataFrame, which: DataFrame, editor: str, now) -> Changed:
        """As :func:`overlay.remove_overrides`; a correction names its row."""
        rows = overrides.join(which.select("record_key", "field").distinct(), ["record_key", "field"], "left_semi").filter("record_id is not null")
        return self.changed(self._of(rows, "record_id"), lambda cat: overlay.remove_overrides(cat, overrides, log, which, editor, now))
