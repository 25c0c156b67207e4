"""Secret scans by multipart credential linking.

A credential has parts: an access identifier, a secret, an endpoint.  Some parts
are telling by themselves (the base kinds below) and always reported.  Others, a
user name, an opaque string, an address, mean nothing alone: they are weak
candidates, reported only where complementary parts stand with them.

Every part is an interval of the text, widened by a reach and cut at the borders
of its scope (a paragraph).  The join of these intervals with the parts of each
role needs no pairs: of sorted starts and ends, the parts that meet an interval
are those that start before its end less those that end before its start.  So a
text of any number of parts takes time in proportion to its length, but for one
sort of its parts.

Fixed values: the patterns of the base kinds.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import take_worker

#: Kinds in the order in which they are listed at one place; the first three are the base.
KINDS = ["assign", "access", "hex", "user", "opaque", "endpoint"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

#: Weak candidates: names given to users and clients, long strings of mixed signs, addresses and hosts.
USER = re.compile(r"""(?:user(?:name)?|login|client_?id|account_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}""", re.ASCII | re.IGNORECASE)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}")
ADDRESS = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]{1,20}://(?:([^\s:/@"'<>]{1,256}):([^\s:/@"'<>]{1,256})@)?[^\s"'<>]+""")
HOST = re.compile(r"""(?:host(?:name)?|server|endpoint)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:_-]{3,}""", re.ASCII | re.IGNORECASE)
BORDER = re.compile(r"\n[ \t\r]*\n")
#: What an opaque string's letters must come to, in bits a sign, beside letters and digits.
ENTROPY = 3.5
REACH = 300

Span = tuple[int, int, int]


def _holds(text: str, words: tuple[str, ...]) -> bool:
    """Whether one of these lower-case words stands in the text: looked up before a pattern that begins with them is."""
    low = text.lower()
    return any(w in low for w in words)


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the base kinds, by start, then kind; leftmost matches of each kind that don't overlap, too short ones dropped."""
    found: list[Span] = []
    if _holds(text, ("passw", "secret", "token", "api")):
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _opaque(word: str) -> bool:
    n = len(word)
    if not any("0" <= c <= "9" for c in word) or word.isdigit():
        return False
    return -sum(k / n * math.log2(k / n) for k in Counter(word).values()) >= ENTROPY


def weak_spans(text: str, base: list[Span]) -> list[Span]:
    """(start, kind, end) of the weak candidates; a name or string that a base span covers in part is none."""
    found, hosts = [], []
    if "://" in text:
        for m in ADDRESS.finditer(text):
            hosts.append((m.start(), 5, m.end()))
            if m.end(2) > 0:
                found += [(m.start(1), 3, m.end(1)), (m.start(2), 4, m.end(2))]
    if _holds(text, ("user", "login", "client", "account", "access")):
        found += [(m.start(), 3, m.end()) for m in USER.finditer(text)]
    if not found and not any(k == 1 for _, k, _ in base):
        return []  # without a name nothing is linked
    found += [(m.start(), 4, m.end()) for m in OPAQUE.finditer(text) if _opaque(m[0])]
    if _holds(text, ("host", "server", "endpoint")):
        hosts += [(m.start(), 5, m.end()) for m in HOST.finditer(text)]
    if base and found:
        found = [s for s, n in zip(found, _meeting(*_sorted(base), np.array([s[0] for s in found]), np.array([s[2] for s in found])), strict=True) if not n]
    return sorted({*found, *hosts})


def _sorted(spans: list[Span]) -> tuple[np.ndarray, np.ndarray]:
    return np.sort(np.array([s[0] for s in spans], np.int64)), np.sort(np.array([s[2] for s in spans], np.int64))


def _meeting(starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How many of the intervals with these sorted starts and ends meet each [low, high)."""
    return np.searchsorted(starts, high, "left") - np.searchsorted(ends, low, "right")


def linked_spans(text: str, base: list[Span], reach: int = REACH) -> list[Span]:
    """The weak candidates that complementary parts stand with.

    A secret or a name is reported where the other of the two is in reach and
    either that is a base span or an endpoint is in reach too; an endpoint where a
    name and a secret are.
    """
    weak = weak_spans(text, base)
    by = [[s for s in base + weak if s[1] == k] for k in range(len(KINDS))]
    if not weak or not (by[1] or by[3]) or not (by[0] or by[2] or by[4]):
        return []
    borders = np.array([0, *(m.end() for m in BORDER.finditer(text)), len(text)], np.int64)
    at = np.array([(s, e) for s, _, e in weak], np.int64)
    low = np.maximum(at[:, 0] - reach, borders[np.searchsorted(borders, at[:, 0], "right") - 1])
    high = np.minimum(at[:, 1] + reach, borders[np.minimum(np.searchsorted(borders, at[:, 1] - 1, "right"), len(borders) - 1)])

    def near(*kinds: int) -> np.ndarray:
        own = [s for k in kinds for s in by[k]]
        return _meeting(*_sorted(own), low, high) > 0 if own else np.zeros(len(weak), bool)

    sure_name, name, sure_secret, secret, place = near(1), near(3), near(0, 2), near(4), near(5)
    kind = np.array([k for _, k, _ in weak])
    kept = np.where(kind == 3, sure_secret | secret & place, np.where(kind == 4, sure_name | name & place, (sure_name | name) & (sure_secret | secret)))
    return [s for s, k in zip(weak, kept, strict=True) if k]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """Secrets of whole texts, a row for each row: ``doc_id``, ``base`` and ``spans``, arrays of (kind, start, end).

    ``base`` has the spans of the base kinds, ``spans`` those and the weak
    candidates that were linked, both by start, then kind as listed; places are
    code points, ends exclusive.  Null and empty texts have none.  Rows are judged
    one by one, also those that repeat an id or have none; spans of several kinds
    at one place are all listed.  Further columns are not read.
    """
    span = "array<struct<kind: string, start: long, end: long>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def told(spans: list[Span]) -> list[dict]:
        return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("secret_scan")
        for batch in batches:
            base = [base_spans(t.as_py() or "") for t in batch.column(1)]
            more = [sorted(b + linked_spans(t.as_py() or "", b, reach)) for t, b in zip(batch.column(1), base, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(told, base), kind), pa.array(map(told, more), kind)], names=["doc_id", "base", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, base {span}, spans {span}")
