"""Language-model scoring by a weighted backoff automaton over smoothed n-grams.

Model: word n-grams of the training texts with Dirichlet smoothing,

    p(w)     = (c(w) + 0.5) / (N + 0.5 (V + 1))
    p(w | h) = (c(h w) + m p(w | h')) / (c(h) + m)       h' = h without its first word

which sums to one over the seen words and one unseen word.  As an automaton:
each seen n-gram h is a state; a seen h w is an arc of weight log p(w | h) to the
longest state that ends h w; any other word takes the failure arc of weight
log m / (c(h) + m) to the state h'; at the state of no words an unseen word takes an
arc of its own weight back to it.  A text is read once from left to right: the state
is carried along, failure arcs are followed until an arc fits, weights are added up.

No machine holds the automaton of the whole corpus.  Texts are dealt to blocks;
each block lists its distinct n-grams once, packed in arrays and dealt by hash to
buckets; a bucket sums the training counts of its n-grams over all blocks and
sends each block the counts of just the n-grams it asked about.  With those a
block builds the part of the automaton its own texts can reach, and walks it.
Counts are pre-aggregated in blocks before the shuffle, so a very common n-gram is
one entry per block.  Only filled slices of a block are sent, and blocks grow with
the square root of the corpus (up to 64 MB), so that the rows sent follow the bytes.

N-grams are known by hashes of 18 bits more than the corpus' size needs, 48 to 64:
about one in a million meets another's count.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, on_release, take_worker, written

#: The end of a text, counted as a token; no word holds a blank.
END = xxhash.xxh3_64_intdigest(b" end ")
MIX = np.uint64(0x9E3779B97F4A7C15)

_WORDS: list[Memo] = []
on_release(_WORDS.clear)


def word_hashes(words: list[bytes]) -> list[int]:
    if not _WORDS:
        _WORDS.append(Memo(lambda ws: [xxhash.xxh3_64_intdigest(w) for w in ws], 150_000))
    memo = _WORDS[0]
    memo.fill(words)
    return list(map(memo.__getitem__, words))


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case, parted by ASCII white space."""
    return (text or "").encode().lower().split()


def ngram_hashes(words: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each place, per order; 0 where a text has fewer words before it.

    ``first`` is the distance of each place from the start of its text.
    """
    out = [words]
    for n in range(2, order + 1):
        h = np.zeros_like(words)
        prev = np.empty_like(words)
        prev[1:] = out[-1][:-1]
        prev[:1] = 0
        h = (prev ^ (prev >> np.uint64(29))) * MIX + words * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(n)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h[first < n - 1] = 0
        out.append(h)
    return out


def packed(x: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes: the first bytes of all, the second of all, and so on."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1)


def unpacked(data: bytes, dtype: str) -> np.ndarray:
    x = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(x.T).reshape(-1).view(dtype)


def packed_sorted(x: np.ndarray) -> bytes:
    """Sorted hashes by their differences, whose upper bytes are few."""
    return packed(np.diff(x, prepend=np.uint64(0)).astype("<u8"))


def unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, "<u8"), dtype=np.uint64)


class Block:
    """The n-grams of a block of texts."""

    def __init__(self, texts: list[str | None], order: int, bits: int = 64):
        cut = [tokens(t) for t in texts]
        self.sizes = np.array([len(c) + 1 for c in cut], np.int64)
        flat: list[int] = []
        for c in cut:
            flat += word_hashes(c)
            flat.append(END)
        words = np.array(flat, np.uint64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1])).astype(np.int64)
        self.first = np.arange(len(words)) - np.repeat(self.starts, self.sizes)
        self.distinct, self.inverse = [], []
        for g in ngram_hashes(words, self.first, order):
            u, i = np.unique(g >> np.uint64(64 - bits), return_inverse=True)
            self.distinct.append(u)
            self.inverse.append(i)


def bucket_of(h: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Buckets are ranges of a hash of ``bits`` bits, so that sorted hashes fall into runs."""
    high = h >> np.uint64(bits - 32) if bits > 32 else h << np.uint64(32 - bits)
    return (high * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def score(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
    order: int = 3, strength: float = 16.0, block_bytes: int | None = None, buckets: int | None = None,
) -> DataFrame:
    """Score every whole text: ``doc_id``, ``in_train``, ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score`` (unigrams alone), ``score``.

    ``train`` says from which rows to learn (null: not).  One row for each row;
    null texts are one end token, ids may repeat or be null, further columns are
    not read, an empty table gives no row.  Scores are log10 probabilities.
    Without training rows every token has the unseen word's probability, 1.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 1)).first()[0] or 0
    block_bytes = block_bytes or min(max(8 << 20, math.isqrt(8 * total)), 64 << 20)
    blocks = max(1, math.ceil(total / block_bytes))
    n_buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / (64 << 20)))
    bits = min(64, max(48, 18 + (total + 1).bit_length()))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("in_train"),
    ).withColumn("block", F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 64)), F.lit(blocks)).cast("int"))
    dealt = rows.repartition("block")

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        """The block's n-grams, with their counts in its training texts, cut by bucket."""
        take_worker("words")
        b = Block(list(pdf["text"]), order, bits)
        weight = np.repeat(pdf["in_train"].to_numpy(np.float64), b.sizes)
        out: dict[str, list] = {f"{x}{n}": [] for n in range(order) for x in "gc"}
        filled = np.zeros(n_buckets, bool)
        for n, (u, i) in enumerate(zip(b.distinct, b.inverse, strict=True)):
            c = np.bincount(i, weight, len(u)).astype("<u4")
            edge = np.searchsorted(bucket_of(u, n_buckets, bits), np.arange(n_buckets + 1))
            filled |= edge[1:] > edge[:-1]
            for k in range(n_buckets):
                full = edge[k + 1] > edge[k]
                out[f"g{n}"].append(packed_sorted(u[edge[k] : edge[k + 1]]) if full else None)
                out[f"c{n}"].append(packed(c[edge[k] : edge[k + 1]]) if full else None)
        sent = pd.DataFrame({"block": int(pdf["block"].iloc[0]), "bucket": np.arange(n_buckets)} | out)
        return sent[filled]

    fields = "".join(f", g{n} binary, c{n} binary" for n in range(order))
    asked = dealt.groupBy("block").applyInPandas(ask, "block int, bucket int" + fields)

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        """Sums over all blocks, for each block in the order it asked."""
        out = {"block": pdf["block"], "bucket": pdf["bucket"]}
        total_tokens = kinds = 0
        for n in range(order):
            asked_for = [unpacked_sorted(x) if x is not None else np.zeros(0, np.uint64) for x in pdf[f"g{n}"]]
            count = np.concatenate([unpacked(x, "<u4") for x in pdf[f"c{n}"] if x is not None] or [np.zeros(0)])
            u, i = np.unique(np.concatenate(asked_for), return_inverse=True)
            c = np.bincount(i, count, len(u)).astype("<u8")
            if n == 0:
                total_tokens, kinds = int(c.sum()), int((c > 0).sum())
            each = c[i].astype("<u4" if not len(c) or c.max() < 2**32 else "<u8")
            edge = np.cumsum([0] + [len(x) for x in asked_for])
            out[f"c{n}"] = [packed(each[a:b]) if b > a else None for a, b in zip(edge[:-1], edge[1:], strict=True)]
            out[f"w{n}"] = [each.itemsize] * len(pdf)
        return pd.DataFrame(out | {"tokens": total_tokens, "kinds": kinds})

    kind = "block int, bucket int" + "".join(f", c{n} binary, w{n} int" for n in range(order)) + ", tokens long, kinds long"
    answered = written(asked.groupBy("bucket").applyInPandas(answer, kind), "counts")
    figures = answered.groupBy("bucket").agg(F.max("tokens").alias("t"), F.max("kinds").alias("k")).agg(F.sum("t").alias("t"), F.sum("k").alias("k")).first()
    n_all, n_kinds = figures["t"] or 0, figures["k"] or 0

    def finish(pdf: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        take_worker("words")
        b = Block(list(pdf["text"]), order, bits)
        got = got.sort_values("bucket")
        count = [
            np.concatenate([unpacked(x, f"<u{w}").astype(np.float64) for x, w in zip(got[f"c{n}"], got[f"w{n}"], strict=True) if x is not None] or [np.zeros(0)])
            for n in range(order)
        ]
        known, base, full, _ = Automaton(b, count, n_all, n_kinds, strength).walk()
        return pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "in_train": pdf["in_train"].to_numpy(), "n_tokens": b.sizes, "n_known": known, "train_tokens": n_all, "base_score": base, "score": full})

    done = "in_train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInPandas(finish, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {done}")


class Automaton:
    """The states, arcs and failure arcs that the texts of one block can reach.

    State 0 stands for no words; the n-grams of n words (n below the order) have
    the states from ``base[n]`` on, in the order of the block's distinct n-grams,
    of which those are in use that training has seen.  ``fail_to`` and
    ``fail_weight`` go by state.  The arcs of n + 1 words are those of the block's
    distinct n-grams that training has seen: ``arc_from[n]`` (their state of n
    words), ``arc_to[n]`` and ``arc_weight[n]``; ``seen[n]`` tells which are there.
    """

    def __init__(self, block: Block, counts: list[np.ndarray], n_all: int, kinds: int, strength: float):
        self.block, order = block, len(counts)
        sizes = [len(c) for c in counts]
        self.base = np.concatenate(([0, 1], 1 + np.cumsum(sizes[: order - 1]))).astype(np.int64)
        states = int(self.base[order])
        self.fail_to, self.fail_weight = np.zeros(states, np.int64), np.zeros(states)
        self.seen = [c > 0 for c in counts]
        self.arc_from, self.arc_to, self.arc_weight = [], [], []
        places = np.arange(len(block.first))
        p_shorter = None
        for n, c in enumerate(counts):
            at = np.zeros(len(c), np.int64)  # a place at which the n-gram ends
            fit = block.first >= n
            at[block.inverse[n][fit]] = places[fit]
            if n == 0:
                p = (c + 0.5) / (n_all + 0.5 * (kinds + 1))
                origin = np.zeros(len(c), np.int64)
            else:
                suffix, prefix = block.inverse[n - 1][at], block.inverse[n - 1][np.maximum(at - 1, 0)]
                p = (c + strength * p_shorter[suffix]) / (counts[n - 1][prefix] + strength)
                origin = self.base[n] + prefix
            own = self.base[n + 1] + np.arange(len(c)) if n + 1 < order else (self.base[n] + suffix if n else np.zeros(len(c), np.int64))
            if n + 1 < order:
                self.fail_to[own] = self.base[n] + suffix if n else 0
                self.fail_weight[own] = np.log10(strength / (c + strength))
            self.arc_from.append(origin)
            self.arc_to.append(own)
            self.arc_weight.append(np.log10(p))
            p_shorter = p

    def walk(self, lane: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: known tokens, sum of unigram weights, sum along the path; and how many failure arcs were followed.

        Texts are read from left to right with a carried state, a token a step.
        All texts of the block advance side by side; a long text is cut into
        lanes, each of which reads the order - 1 tokens before it without counting
        them, and so comes to the state that the whole text would carry there.
        """
        b, order = self.block, len(self.seen)
        seen, weight = self.seen[0][b.inverse[0]], self.arc_weight[0][b.inverse[0]]
        base = np.add.reduceat(weight, b.starts)
        known = np.add.reduceat(seen.astype(np.int64), b.starts)

        pieces = -(-b.sizes // lane)
        text = np.repeat(np.arange(len(b.sizes)), pieces)
        begin = b.starts[text] + lane * (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        end = np.minimum(begin + lane, b.starts[text] + b.sizes[text])
        at = np.maximum(begin - (order - 1), b.starts[text])
        longest = np.argsort(at - end, kind="stable")  # lanes that end first stand last
        text, begin, end, at = text[longest], begin[longest], end[longest], at[longest]
        state, words = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        sums, failures, live = np.zeros(len(at)), np.zeros(len(at), np.int64), len(at)
        for step in range(lane + order - 1):
            while live and at[live - 1] + step >= end[live - 1]:
                live -= 1
            if not live:
                break
            place = at[:live] + step
            added = np.zeros(live)
            waiting = np.ones(live, bool)
            for n in range(order - 1, -1, -1):
                here = np.flatnonzero(waiting & (words[:live] == n))
                if not len(here):
                    continue
                gram = b.inverse[n][place[here]]
                fits = self.seen[n][gram] if n else np.ones(len(here), bool)
                go, back = here[fits], here[~fits]
                arc = gram[fits]
                added[go] += self.arc_weight[n][arc]
                if n:
                    state[go], words[go] = self.arc_to[n][arc], min(n + 1, order - 1)
                else:  # an unseen word stays at the state of no words
                    state[go] = np.where(self.seen[0][arc], self.arc_to[0][arc], 0)
                    words[go] = np.where(self.seen[0][arc], min(1, order - 1), 0)
                waiting[go] = False
                added[back] += self.fail_weight[state[back]]
                failures[back] += place[back] >= begin[back]
                state[back] = self.fail_to[state[back]]
                words[back] = n - 1
            sums[:live] += np.where(place >= begin[:live], added, 0.0)
        return known, base, np.bincount(text, sums, len(b.sizes)), np.bincount(text, failures, len(b.sizes)).astype(np.int64)
