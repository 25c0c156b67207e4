"""Edit-aware token counts.

Each edited document keeps a segment tree over its pre-token segments: every
node holds the number of characters and of tokens below it.  An edit finds its
leaves by offset on the way down, takes one whole segment of context on either
side, re-encodes that region alone, puts its segments back as leaves and updates
the sums on the way up; however many edits meet at one place, each re-encodes only
the segments around it.
Unedited parts are never encoded again; distinct segments are encoded once in a
worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, by_size, on_release, take_worker
from .tokenizers_io import encode_bytes

#: Blanks and line ends before a segment belong to it: its start is always a token boundary.
SEGMENT = re.compile(r"[ \n]*[^ \n]+|[ \n]+")


def segments(text: str) -> list[str]:
    """The text cut before each blank or line end that follows another sign.

    A blank after other white space (tabs, no-break spaces) starts no segment,
    since the tokenizer may join the two.
    """
    out: list[str] = []
    for s in SEGMENT.findall(text):
        if out and (out[-1][-1].isspace() or s.isspace()):
            out[-1] += s
        else:
            out.append(s)
    return out


class CountTree:
    """Sums of characters and tokens over the segments of one document."""

    def __init__(self, parts: list[str], count):
        self.count, self.reencoded = count, 0
        self._build(parts, count(parts))

    def _build(self, parts: list[str], tokens: list[int], room: int = 1) -> None:
        """Lay out the leaves, each with ``room`` - 1 empty ones behind it."""
        n = 1
        while n < max(1, room * len(parts)):
            n *= 2
        self.n = n
        self.parts, self.chars, self.tokens = [""] * n, [0] * (2 * n), [0] * (2 * n)
        for i, (part, t) in enumerate(zip(parts, tokens, strict=True)):
            self.parts[room * i], self.chars[n + room * i], self.tokens[n + room * i] = part, len(part), t
        for sums in (self.chars, self.tokens):
            for i in range(n - 1, 0, -1):
                sums[i] = sums[2 * i] + sums[2 * i + 1]

    def leaf(self, offset: int) -> tuple[int, int]:
        """The leaf that holds the character at ``offset`` and the offset of its start."""
        i, start = 1, 0
        while i < self.n:
            i *= 2
            if offset >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.n, start

    def _put(self, leaf: int, text: str, tokens: int) -> None:
        self.parts[leaf] = text
        i = leaf + self.n
        self.chars[i], self.tokens[i] = len(text), tokens
        i //= 2
        while i:
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            i //= 2

    def edit(self, start: int, end: int, text: str) -> None:
        """Replace the characters ``start`` to ``end`` of the present text; offsets are clipped to it."""
        total = self.chars[1]
        start = min(max(0, start), total)
        end = min(max(start, end), total)
        a, at = self.leaf(max(0, start - 1))
        while a > 0 and (at or not self.parts[a]):  # one filled segment of context before the touched one
            a -= 1
            at -= len(self.parts[a])
            if self.parts[a]:
                break
        b, _ = self.leaf(max(0, min(end, total - 1)))
        b_end = b + 1
        while b_end < self.n:
            b_end += 1
            if self.parts[b_end - 1]:
                break
        old = "".join(self.parts[a:b_end])
        new = old[: start - at] + text + old[end - at :]
        pieces = segments(new)
        tokens = self.count(pieces) if pieces else []
        self.reencoded += len(new)
        if len(pieces) > b_end - a:  # no room: lay all leaves out anew, without encoding any
            filled = [i for i in range(self.n) if self.parts[i]]
            before, after = [i for i in filled if i < a], [i for i in filled if i >= b_end]
            counts = [[self.tokens[self.n + i] for i in side] for side in (before, after)]
            self._build([self.parts[i] for i in before] + pieces + [self.parts[i] for i in after], counts[0] + tokens + counts[1], 2)
            return
        for i in range(a, b_end):
            piece, t = (pieces[i - a], tokens[i - a]) if i - a < len(pieces) else ("", 0)
            if piece or self.parts[i]:
                self._put(i, piece, t)

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.parts)


_COUNTS: dict = {}
on_release(_COUNTS.clear)


def counter(path: str):
    """Token counts of segments; distinct ones are encoded once in a worker."""
    if path not in _COUNTS:
        memo = Memo(lambda texts: [len(x) // 4 for x in encode_bytes(path, texts)], 300_000)

        def count(parts: list[str]) -> list[int]:
            memo.fill(parts)
            return list(map(memo.__getitem__, parts))

        _COUNTS[path] = count
    return _COUNTS[path]


EDITS = "array<struct<start:int,end:int,text:string>>"


def redactions(docs: DataFrame, rules: list[tuple[str, str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Edits that replace each match of the given patterns, last match first.

    Adds ``edits`` to the id and text; from the last to the first, so that an
    edit never moves a later one.  Overlapping matches: the first rule wins.
    """
    compiled = [(re.compile(p), t) for p, t in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edits = []
            for t in batch.column(1).to_pylist():
                found, taken = [], []
                for pattern, into in compiled:
                    for m in pattern.finditer(t or ""):
                        if m.end() > m.start():
                            found.append((m.start(), m.end(), into))
                found.sort(key=lambda x: x[0])
                for s in found:
                    if not taken or s[0] >= taken[-1][1]:
                        taken.append(s)
                edits.append([{"start": a, "end": b, "text": x} for a, b, x in reversed(taken)])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(edits, kind)], names=["doc_id", "text", "edits"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, edits {EDITS}")


def count_with_edits(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """Token counts before and after the edits of each document.

    ``edits`` are applied one after the other, each with offsets in the text as
    the ones before it left it; a null edit or text of an edit counts as
    nothing.  Returns one row for each row: ``doc_id``, ``n_edits``,
    ``n_tokens_before``, ``n_tokens_after``, ``n_chars_after``,
    ``chars_reencoded`` (characters of the regions encoded again).  A null text
    counts as empty.  Repeated rows and ids are counted each by itself, an empty
    table gives no row, further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("edit_counts")
        count = counter(path)
        for batch in batches:
            at = 0
            rows = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            for part in by_size(rows, (len(t or "") for t, _ in rows), 2 << 20):
                cut = [segments(t or "") for t, _ in part]
                count([s for x in cut for s in x])
                out = []
                for (_, edits), parts in zip(part, cut, strict=True):
                    edits = [e for e in edits or [] if e]
                    if not edits:
                        n = sum(count(parts))
                        out.append((0, n, n, sum(map(len, parts)), 0))
                        continue
                    tree = CountTree(parts, count)
                    before = tree.total
                    for e in edits:
                        tree.edit(e["start"] or 0, e["end"] if e["end"] is not None else e["start"] or 0, e["text"] or "")
                    out.append((len(edits), before, tree.total, tree.chars[1], tree.reencoded))
                names = ["n_edits", "n_tokens_before", "n_tokens_after", "n_chars_after", "chars_reencoded"]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))], names=["doc_id", *names])
                at += len(part)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(edits_col).cast(EDITS).alias("edits"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_edits long, n_tokens_before long, n_tokens_after long, n_chars_after long, chars_reencoded long")
