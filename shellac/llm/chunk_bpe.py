"""BPE encoding with content-defined chunk reuse, and decoding.

A rolling hash over the UTF-8 bytes cuts each text where its contents say so, so
that passages shared by documents give the same chunks wherever they stand.  A
chunk is encoded once by itself, and its ids are reused from a memo that is
bounded by bytes in each Python worker.  Chunks begin and end in the middle of
words, so their outer ids are wrong.  Each join of two chunks is repaired: a window
over the join, from a blank in the left chunk to one in the right, is re-encoded
and its ids are compared with those of both chunks over a word at each end; where
they differ the window grows by further words, until both ends agree.  Then the
ids of the left chunk up to the agreement, of the window, and of the right chunk
from there on are put together.  Blanks after a visible ASCII sign are where a
byte-level BPE always parts words, so two encodings that agree at one agree beyond
it.  A text whose joins do not come to agree is encoded as a whole.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, by_size, on_release, take_worker
from .tokenizers_io import encode_bytes, tokenizer

WINDOW, LEAST, MOST = 16, 64, 8192
#: Where words always part: a blank or line end after a visible ASCII sign.
PARTING = re.compile(rb"(?<=[!-~])[ \n]")
#: A group of chunks has so many partings at least, or is all of its text.
PARTINGS = 4


def cuts(data: bytes, mean: int) -> list[int]:
    """End positions of the chunks of one text.

    A cut stands where the hash of the 16 bytes before it is divisible by
    ``mean``, at least 64 and at most about 8192 bytes after the last one,
    never inside a character.
    """
    n, out, last = len(data), [], 0
    if n > LEAST:
        x = np.frombuffer(data, np.uint8).astype(np.uint32)
        h = np.zeros(n - WINDOW + 1, np.uint32)
        for k in range(WINDOW):
            h *= np.uint32(0x01000193)
            h += x[k : n - WINDOW + 1 + k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        for at in [*(np.flatnonzero(h % np.uint32(mean) == 0) + WINDOW).tolist(), n]:
            while at - last > MOST:
                to = last + MOST
                while data[to] & 0xC0 == 0x80:
                    to -= 1
                out.append(to)
                last = to
            if at - last >= LEAST and at < n and data[at] & 0xC0 != 0x80:
                out.append(at)
                last = at
    if n > last:
        out.append(n)
    return out


class Chunk:
    """One chunk (or some that have too few blanks each): its bytes, ids, and where they end."""

    __slots__ = ("data", "ids", "ends", "partings")

    def __init__(self, data: bytes, ids: bytes, lengths: np.ndarray):
        self.data, self.ids = data, ids
        self.ends = array("i", np.cumsum(lengths[np.frombuffer(ids, "<u4")], dtype=np.int32).tobytes())
        self.partings = array("i", [m.start() for m in PARTING.finditer(data)])

    def __len__(self) -> int:
        return len(self.data) + 2 * len(self.ids) + 4 * len(self.partings) + 300

    def upto(self, at: int) -> int | None:
        """Size of the ids that cover the first ``at`` bytes; None if an id reaches across."""
        k = bisect_left(self.ends, at)
        return 4 * k + 4 if k < len(self.ends) and self.ends[k] == at else 0 if at == 0 else None


class ChunkEncoder:
    """Encodes texts of one worker; ``grown`` counts windows that had to grow, ``whole`` texts encoded without chunks."""

    def __init__(self, path: str, mean: int = 512, most_bytes: int = 64 << 20):
        self.path, self.mean, self.grown, self.whole = path, mean, 0, 0
        self.lengths = np.array([len(x) for x in byte_table(path)], np.int64)
        self.chunks = Memo(self._encoded, 200_000, most_bytes)
        self.joins = Memo(lambda texts: encode_bytes(path, [t.decode() for t in texts]), 200_000, most_bytes // 2)

    def _encoded(self, chunks: list[bytes]) -> list[Chunk]:
        ids = encode_bytes(self.path, [c.decode() for c in chunks])
        return [Chunk(c, x, self.lengths) for c, x in zip(chunks, ids, strict=True)]

    def cut(self, data: bytes) -> list[bytes]:
        """The chunks of a text, those with few blanks joined to the next."""
        out, last, seen, found = [], 0, 0, 0
        for end in cuts(data, self.mean):
            for _ in PARTING.finditer(data, seen, end):
                found += 1
                if found == PARTINGS:
                    break
            seen = end
            if found == PARTINGS:
                out.append(data[last:end])
                last, found = end, 0
        if last < len(data):
            rest = data[last:]
            out = [*out[:-1], out[-1] + rest] if out else [rest]
        return out

    @staticmethod
    def window(left: Chunk, right: Chunk, words: int) -> tuple[int, int, int, int] | None:
        """Bounds of a window: from and to of the left word compared, from and to of the right one; None if a chunk has no more words."""
        if words + 2 > min(len(left.partings), len(right.partings)):
            return None
        return left.partings[-words - 1], left.partings[-words], right.partings[words - 1], right.partings[words]

    @staticmethod
    def agreed(left: Chunk, right: Chunk, bounds: tuple[int, int, int, int], ids: bytes) -> tuple[int, bytes, int] | None:
        """(size of the ids kept of the left chunk, ids between, size left out of the right one) if the window agrees with both."""
        la, lb, rc, rd = left.upto(bounds[0]), left.upto(bounds[1]), right.upto(bounds[2]), right.upto(bounds[3])
        if la is None or lb is None or rc is None or rd is None:
            return None
        head, tail = lb - la, len(ids) - (rd - rc)
        if head > tail or ids[:head] != left.ids[la:lb] or ids[tail:] != right.ids[rc:rd]:
            return None
        return lb, ids[head:tail], rc

    def joined(self, chunks: list[Chunk]) -> bytes | None:
        """Ids of a text from its chunks; None if a join does not come to agree."""
        out, begin = [], 0
        for left, right in zip(chunks[:-1], chunks[1:], strict=True):
            words, got = 1, None
            while got is None:
                bounds = self.window(left, right, words)
                if bounds is None:
                    return None
                text = left.data[bounds[0] :] + right.data[: bounds[3]]
                if text not in self.joins:
                    self.joins.fill([text])
                got = self.agreed(left, right, bounds, self.joins[text])
                self.grown += words > 1
                words *= 2
            if got[0] < begin:
                return None
            out += [left.ids[begin : got[0]], got[1]]
            begin = got[2]
        out.append(chunks[-1].ids[begin:])
        return b"".join(out)

    def __call__(self, texts: list[str]) -> list[bytes]:
        out = []
        for part in by_size(texts, (len(t) for t in texts), 1 << 20):
            cut = [self.cut(t.encode()) for t in part]
            self.chunks.fill({c for x in cut for c in x})
            made = [[self.chunks[c] for c in x] for x in cut]
            first = {left.data[w[0] :] + right.data[: w[3]] for x in made for left, right in zip(x[:-1], x[1:], strict=True) if (w := self.window(left, right, 1))}
            self.joins.fill(first)
            for text, x in zip(part, made, strict=True):
                ids = (self.joined(x) if len(x) > 1 else x[0].ids) if x else b""
                if ids is None:
                    self.whole += 1
                    ids = encode_bytes(self.path, [text])[0]
                out.append(ids)
        return out


_ENCODERS: dict = {}
on_release(_ENCODERS.clear)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", mean_chunk: int = 512) -> DataFrame:
    """Ids of every whole text: ``doc_id``, ``n_tokens``, ``ids`` (little-endian
    unsigned 32-bit integers, binary).

    One row for each row of ``docs``, repeated ids included; null and empty texts
    have no ids, an empty table gives no row, further columns are not read.  Each
    partition is encoded by itself without a shuffle; memory is bounded by one
    Arrow batch and the memos.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("chunk_bpe")
        key = (path, mean_chunk)
        if key not in _ENCODERS:
            _ENCODERS[key] = ChunkEncoder(path, mean_chunk)
        made = _ENCODERS[key]
        for batch in batches:
            at = 0
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in by_size(texts, (len(t) for t in texts), 4 << 20):
                ids = made(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "n_tokens", "ids"],
                )
                at += len(part)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary")


def byte_table(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary.

    Byte-level files write the 188 printable Latin-1 signs as themselves and the
    other bytes as the letters from U+0100 on, in order; the table is built from
    that rule.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    letters = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}
    vocab = tokenizer(path).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    return out


_TABLES: dict = {}
on_release(_TABLES.clear)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of ids: all columns of ``encoded`` named here, and ``decoded``.

    Bytes of all ids are joined first and then read as UTF-8, each broken
    sequence giving U+FFFD, as the library does with special tokens kept.  Null
    ids give an empty text, ids outside the vocabulary nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("chunk_bpe")
        if path not in _TABLES:
            _TABLES[path] = byte_table(path)
        table = _TABLES[path]
        get, top = table.__getitem__, len(table)
        for batch in batches:
            at = 0
            for part in by_size(batch.column(1).to_pylist(), (len(x) if (x := v.as_py()) else 0 for v in batch.column(1)), 8 << 20):
                texts = []
                for x in part:
                    ids = array("I", x or b"")
                    if ids and max(ids) >= top:
                        ids = [i for i in ids if i < top]
                    texts.append(b"".join(map(get, ids)).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])
                at += len(part)

    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string")
