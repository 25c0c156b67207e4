"""Token-id files: fixed-width bit packing with block offsets.

File layout (little endian)::

    blocks   ``block`` ids of ``bits`` bits each, the last one padded
    table 1  block offsets, u64 each, from the start of the file
    table 2  end of each document in ids, u64 each, within the file
    table 3  document ids, i64 each (the smallest value stands for null)
    footer   magic b"SHPI", version u32, bits u32, block u32,
             n_ids u64, n_docs u64, n_blocks u64

A block always fills whole 64-bit words, so that any block can be unpacked by
itself with a handful of numpy operations and any id is reached with one seek.
The tables stand behind the blocks, so that blocks go to the file as they fill.
"""

from __future__ import annotations

import io
import struct
import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, take_worker

MAGIC, VERSION, BLOCK = b"SHPI", 2, 4096
FOOTER = struct.Struct("<4sIIIQQQ")
NULL_ID = -(2**63)


def bits_for(vocabulary: int) -> int:
    """Least bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """Ids (a multiple of 64 of them) as 64-bit words of ``bits`` bits each."""
    rows = ids.astype(np.uint64, copy=False).reshape(-1, 64)
    words = np.zeros((len(rows), bits), dtype="<u8")
    for i in range(64):
        at, shift = divmod(i * bits, 64)
        words[:, at] |= rows[:, i] << np.uint64(shift)
        if shift + bits > 64:
            words[:, at + 1] |= rows[:, i] >> np.uint64(64 - shift)
    return words.reshape(-1)


def unpack(words: np.ndarray, bits: int) -> np.ndarray:
    """The inverse of :func:`pack`."""
    rows = words.reshape(-1, bits)
    ids = np.empty((len(rows), 64), dtype=np.uint64)
    mask = np.uint64((1 << bits) - 1)
    for i in range(64):
        at, shift = divmod(i * bits, 64)
        x = rows[:, at] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | (rows[:, at + 1] << np.uint64(64 - shift))
        ids[:, i] = x & mask
    return ids.reshape(-1).astype("<u4")


class Writer:
    """Writes one file; documents come in order, memory holds 64 blocks of ids and 16 bytes a document."""

    def __init__(self, out: io.RawIOBase, bits: int, block: int = BLOCK):
        if block % 64:
            raise ValueError("a block holds a multiple of 64 ids")
        self.out, self.bits, self.block = out, bits, block
        self.pending: list[np.ndarray] = []
        self.held = self.n_ids = 0
        self.ends, self.docs = array("q"), array("q")

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(NULL_ID if doc_id is None else doc_id)
        self.n_ids += len(ids)
        self.ends.append(self.n_ids)
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= 64 * self.block:
            self._flush(self.held // self.block * self.block)

    def _flush(self, count: int) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        self.out.write(pack(ids[:count], self.bits).tobytes())
        self.pending = [ids[count:]]
        self.held = len(ids) - count

    def close(self) -> None:
        """Write the last block, the tables and the footer; the stream stays open."""
        if self.held:
            self.pending.append(np.zeros(-self.held % self.block, np.uint32))
            self.held += len(self.pending[-1])
            self._flush(self.held)
        n_blocks = -(-self.n_ids // self.block)
        step = self.block * self.bits // 8
        self.out.write((step * np.arange(n_blocks, dtype=np.int64)).astype("<u8").tobytes())
        self.out.write(np.array(self.ends, dtype="<u8").tobytes())
        self.out.write(np.array(self.docs, dtype="<i8").tobytes())
        self.out.write(FOOTER.pack(MAGIC, VERSION, self.bits, self.block, self.n_ids, len(self.docs), n_blocks))


class Reader:
    """Random access to one file through any seekable stream."""

    def __init__(self, stream):
        self.stream = stream
        end = stream.seek(0, 2) - FOOTER.size
        if end < 0:
            raise ValueError("not a packed id file")
        stream.seek(end)
        magic, version, self.bits, self.block, self.n_ids, n_docs, n_blocks = FOOTER.unpack(stream.read(FOOTER.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a packed id file")
        stream.seek(end - 8 * (n_blocks + 2 * n_docs))
        self.offsets = np.frombuffer(stream.read(8 * n_blocks), "<u8")
        self.ends = np.frombuffer(stream.read(8 * n_docs), "<u8").astype(np.int64)
        self.docs = np.frombuffer(stream.read(8 * n_docs), "<i8")

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` of the file; reads only the blocks they lie in."""
        end = min(end, self.n_ids)
        if end <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (end - 1) // self.block
        self.stream.seek(int(self.offsets[first]))
        size = (last - first + 1) * self.block * self.bits // 8
        got = unpack(np.frombuffer(self.stream.read(size), "<u8"), self.bits)
        return got[start - first * self.block : end - first * self.block]

    def documents(self, run: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc id, start, ids) of every document, about ``run`` ids at a time."""
        starts = np.concatenate(([0], self.ends[:-1])) if len(self.ends) else self.ends
        at = 0
        while at < len(self.docs):
            to = max(at + 1, int(np.searchsorted(self.ends, starts[at] + run, "right")))
            low = int(starts[at])
            ids = self.ids(low, int(self.ends[to - 1]))
            for k in range(at, to):
                doc = int(self.docs[k])
                yield None if doc == NULL_ID else doc, int(starts[k]), ids[int(starts[k]) - low : int(self.ends[k]) - low]
            at = to


def write_packed(
    docs: DataFrame, encoder: Callable[[], Callable[[list[str]], list[bytes]]], vocabulary: int, out_dir: str | None = None,
    id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK,
) -> DataFrame:
    """Encode ``docs`` and write packed id files in ascending id order.

    ``encoder()`` is called once in each Python worker and returns a function
    from texts to little-endian unsigned 32-bit ids.  Documents are dealt by
    ranges of their id, each range becomes one file, written under a temporary
    name and renamed when complete, so that a task that runs twice leaves one
    valid file.  Null texts count as empty; null ids come first; rows of equal
    id follow each other in order of their text's 64-bit hash, then of the text,
    so that even one id of very many rows spreads over files.  Returns the
    manifest, a row per file: ``shard``, ``path``, ``n_docs``, ``n_ids``,
    ``start`` (ids in all files before it).  An empty table gives an empty
    manifest; further columns are not read.
    """
    spark = docs.sparkSession
    root = out_dir or f"{shared_dir(spark)}/packed-{uuid.uuid4().hex}"
    bits = bits_for(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("packed_ids")
        filled = (batch for batch in batches if batch.num_rows)
        batch = next(filled, None)
        if batch is None:
            return
        encode, shard = encoder(), batch.column(2)[0].as_py()
        store, at = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        store.create_dir(at, recursive=True)
        path, part = f"shard-{shard:07d}.bin", f"{at}/.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            writer = Writer(out, bits, block)
            while batch is not None:
                texts = [t or "" for t in batch.column(1).to_pylist()]
                for doc, ids in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                    writer.add(doc, np.frombuffer(ids, "<u4"))
                batch = next(filled, None)
            writer.close()
        store.move(part, f"{at}/{path}")
        yield pa.RecordBatch.from_pydict(
            {"shard": [shard], "path": [f"{root}/{path}"], "n_docs": [len(writer.docs)], "n_ids": [writer.n_ids]},
            schema=pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
        )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # as many ranges as the reader makes splits, which follow the bytes; rows of one id are parted by a hash of their text
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    placed = (
        rows.withColumn("mark", F.xxhash64("text")).repartitionByRange(ranges, "id", "mark").sortWithinPartitions("id", "mark", "text")
        .select("id", "text", F.spark_partition_id().alias("shard"))
    )
    manifest = f"{root}/manifest"
    placed.mapInArrow(run, "shard long, path string, n_docs long, n_ids long").write.parquet(manifest)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.parquet(manifest).withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_packed(manifest: DataFrame) -> DataFrame:
    """Every document of the files of a manifest, read back from them.

    Columns: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``,
    ``ids`` (little-endian unsigned 32-bit, binary).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
                rows, held = [], 0
                with store.open_input_file(path) as stream:
                    for doc, start, ids in Reader(stream).documents():
                        rows.append((doc, base + start, len(ids), ids.tobytes()))
                        held += 4 * len(ids)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    spark: SparkSession = manifest.sparkSession
    files = manifest.select("path", "start").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
