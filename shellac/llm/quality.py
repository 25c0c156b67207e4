"""Quality classifier by co-training of a text view and a page-metadata view.

The text view sees which telling words a text holds and how it is written, the
metadata view sees language, source and length.  Both start from the labelled
sample; in each round each scores all other documents and labels those it is most
sure of for the other.  Held-out labelled rows calibrate the two views and weigh
them in one probability, with which all documents are scored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, take_worker, written

#: ASCII letters in lower case, digits and the bytes of other scripts stay, all else parts words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
STYLE = 9
GROUPS = np.zeros((256, 4), np.float64)
GROUPS[65:91, 0] = GROUPS[48:58, 1] = GROUPS[10, 3] = 1
GROUPS[[b for b in range(33, 127) if not chr(b).isalnum()], 2] = 1


def word_list(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


def style(text: str, words: list[bytes], distinct: set[bytes]) -> list[float]:
    """How a text is written: length, variety, repetition, shares of capitals, digits, signs, lines."""
    n = len(words)
    data = text.encode()
    total = max(1, len(data))
    shares = (np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ GROUPS / total).tolist() if data else [0.0] * 4
    again = sum(map(bytes.__eq__, words[1:], words)) / n if n else 0.0
    variety = len(distinct) / n if n else 0.0
    return [np.log1p(n) / 5, variety, variety * np.log1p(n) / 5, again, sum(map(len, distinct)) / max(1, len(distinct)) / 10, *(10 * s for s in shares)]


@dataclass
class Logistic:
    """Ridge logistic regression by Newton steps; features are standardised inside."""

    penalty: float = 1.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Logistic:
        weight = np.ones(len(y)) if weight is None else weight
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 0.05)
        a = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        b = np.zeros(a.shape[1])
        ridge = np.full(a.shape[1], self.penalty)
        ridge[-1] = 1e-6
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
            g = a.T @ (weight * (p - y)) + ridge * b
            h = (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + np.diag(ridge)
            step = np.linalg.solve(h, g)
            b -= step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        self.b = b
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.b[:-1] + self.b[-1], -30, 30)


@dataclass
class CoModel:
    words: dict[bytes, int]
    values: dict[tuple[int, str], int]
    n_numbers: int
    text: Logistic
    meta: Logistic
    both: Logistic

    def text_row(self, text: str) -> np.ndarray:
        words = word_list(text)
        distinct = set(words)
        row = np.zeros(STYLE + len(self.words))
        row[:STYLE] = style(text, words, distinct)
        for w in self.words.keys() & distinct:
            row[STYLE + self.words[w]] = 1
        return row

    def meta_row(self, values: list) -> np.ndarray:
        """For each number whether it is there, its logarithm and the square of that; one-hot values of the first columns."""
        at = 3 * self.n_numbers
        row = np.zeros(at + len(self.values))
        n_texts = len(values) - self.n_numbers
        for i, v in enumerate(values[:n_texts]):
            if (i, v) in self.values:
                row[at + self.values[(i, v)]] = 1
        for k, v in enumerate(values[n_texts:]):
            if v is not None:
                z = np.log1p(max(0.0, v)) / 10
                row[3 * k : 3 * k + 3] = 1, z, z * z
        return row

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, m = self.text.logit(text), self.meta.logit(meta)
        return _p(self.both.logit(np.c_[t, m])), _p(t), _p(m)


def _p(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def packed(row: np.ndarray, dense: int) -> bytes:
    """A feature row for storage: the bits behind the first ``dense`` numbers, then these as 32-bit floats."""
    return np.packbits(row[dense:] != 0).tobytes() + row[:dense].astype(np.float32).tobytes()


def unpacked(rows: Iterable[bytes], dense: int, bits: int) -> np.ndarray:
    rows, n_bytes = list(rows), -(-bits // 8)
    if not rows or not n_bytes + dense:
        return np.zeros((len(rows), dense + bits))
    data = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), n_bytes + 4 * dense)
    numbers = np.ascontiguousarray(data[:, n_bytes:]).view(np.float32).astype(np.float64)
    return np.concatenate([numbers.reshape(len(rows), dense), np.unpackbits(data[:, :n_bytes], axis=1, count=bits)], 1)


#: Log-odds are counted by tenths; a view is sure below the first and from the second of these bins (odds of about 1 : 20 and 33 : 1).
SURE_BAD, SURE_GOOD = -30, 35


def surest(counts: dict[int, int], bad: float, good: float) -> list[tuple[int, int, int]]:
    """Bins of the rows a view is surest of: (first, last, rows) for bad and for good ones.

    From either end bins are taken while they hold less than the shares ``bad``
    and ``good`` of all rows, the last of them whole.
    """
    total, found = sum(counts.values()), []
    for bins, most in (([b for b in sorted(counts) if b < SURE_BAD], bad * total), ([b for b in sorted(counts, reverse=True) if b >= SURE_GOOD], good * total)):
        taken: list[int] = []
        for b in bins:
            if sum(counts[t] for t in taken) >= most:
                break
            taken.append(b)
        found.append((min(taken, default=0), max(taken, default=-1), sum(counts[t] for t in taken)))
    return found


def train(
    docs: DataFrame, labels: DataFrame, label_col: str = "good", id_col: str = "doc_id", text_col: str = "text",
    meta_cols: tuple[str, ...] = ("lang", "source"), number_cols: tuple[str, ...] = ("n_chars",),
    most_labelled: int = 10_000, most_sure: int = 800, n_words: int = 400, most_values: int = 200, rounds: int = 3, sure_share: float = 0.2,
) -> CoModel | None:
    """Fit both views on the labelled documents and on what they tell each other about all others.

    ``labels`` holds the id and 0/1 in ``label_col``; rows with nulls are left
    out, of several rows of an id the least label counts.  About
    ``most_labelled`` labelled documents, chosen by a hash of their id, are
    fitted on, three quarters for the views and one for the calibration (all for
    both where a part would lack a kind).  In each round either view scores all
    other documents with a text; the share ``sure_share`` it is surest of, in
    the proportion of the two kinds, is labelled, and of those about
    ``most_sure``, by a hash of id and text, join the other view's rows: repeated
    rows count once.  At most ``n_words`` words are telling, and the
    ``most_values`` most frequent values of each metadata column are told apart.
    Without documents of both kinds there is no model (None), so with an empty
    table.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).dropna().groupBy("id").agg(F.min("y").alias("y"))
    kinds = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(kinds) < 2:
        return None
    part = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30))
    # bounded by its share, so the ids may be broadcast
    chosen = F.broadcast(known.filter(part <= int(min(1.0, most_labelled / sum(kinds.values())) * (1 << 30))))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       *[F.col(c).cast("string").alias(f"m{i}") for i, c in enumerate(meta_cols)], *[F.col(c).cast("double").alias(f"n{i}") for i, c in enumerate(number_cols)])
    names = [c for c in rows.columns if c not in ("id", "text")]
    sample = written(rows.join(chosen, "id"), "sample")

    kind = "id long, y double, words array<binary>"

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted(set(word_list(t))) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.binary()))], names=["id", "y", "words"])

    marked = sample.select("id", "y", "text").mapInArrow(listed, kind)
    good, bad = float(kinds.get(1.0, 0)), float(kinds.get(0.0, 0))
    share = good / max(1.0, good + bad)
    tally = marked.select("y", F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"), F.sum("y").alias("g")).filter("n >= 5")
    excess = (F.col("g") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share) + 1e-6))
    # words whose share of good documents chance would hardly give (3.5 deviations), the most telling first
    telling = [bytes(r["w"]) for r in tally.filter(F.abs(excess) >= 3.5).orderBy(F.abs(excess).desc(), "w").limit(n_words).collect()]
    values: dict[tuple[int, str], int] = {}
    for i in range(len(meta_cols)):
        for r in rows.filter(F.col(f"m{i}").isNotNull()).groupBy(f"m{i}").count().orderBy(F.desc("count"), f"m{i}").limit(most_values).collect():
            values[(i, r[0])] = len(values)
    model = CoModel({w: i for i, w in enumerate(telling)}, values, len(number_cols), Logistic(3.0), Logistic(3.0), Logistic(1.0))
    n_meta = 3 * len(number_cols)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("quality")
        for batch in batches:
            d = batch.to_pydict()
            text = [packed(model.text_row(t), STYLE) for t in d["text"]]
            meta = [packed(model.meta_row(list(v)), n_meta) for v in zip(*(d[c] for c in names), strict=True)] or [b""] * len(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.binary()), pa.array(meta, pa.binary())], names=["y", "h", "text", "meta"])

    def features(df: DataFrame) -> DataFrame:
        return df.select("y", F.xxhash64("id", "text", F.lit(13)).alias("h"), "text", *names).mapInArrow(featured, "y double, h long, text binary, meta binary")

    def tables(found: list) -> tuple[np.ndarray, np.ndarray]:
        return unpacked((r["text"] for r in found), STYLE, len(telling)), unpacked((r["meta"] for r in found), n_meta, len(values))

    got = sorted(features(sample).collect(), key=lambda r: (r["h"], r["y"]))
    y = np.array([r["y"] for r in got])
    if len(set(y)) < 2:
        dropped(sample)
        return None
    held = np.arange(len(y)) % 4 == 0
    own = ~held
    if len(set(y[own])) < 2 or len(set(y[held])) < 2:
        own = held = np.ones(len(y), bool)
    views, xs = (model.text, model.meta), tables(got)
    # features of all other documents, some tenths of a kB each
    others = written(features(rows.filter("text != ''").join(chosen, "id", "left_anti").withColumn("y", F.lit(None).cast("double"))), "others")
    more: tuple[dict, dict] = ({}, {})
    for r in range(rounds + 1):
        for view, x, extra, k in zip(views, xs, more, (0, 1), strict=True):
            at = sorted(extra)
            told = tables([extra[h][0] for h in at])[k]
            view.fit(np.concatenate([x[own], told]), np.array([*y[own], *(extra[h][1] for h in at)]), np.array([1.0] * int(own.sum()) + [0.3] * len(at)))
        if r == rounds:
            break

        @F.pandas_udf("text int, meta int")
        def bins(text: pd.Series, meta: pd.Series) -> pd.DataFrame:
            z = [v.logit(unpacked(c, d, n)) for v, c, d, n in zip(views, (text, meta), (STYLE, n_meta), (len(telling), len(values)), strict=True)]
            return pd.DataFrame({c: np.floor(10 * at).astype(np.int32) for c, at in zip(("text", "meta"), z, strict=True)})

        scored = others.withColumn("b", bins("text", "meta"))
        sides = scored.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("b")[c].alias("b")) for k, c in enumerate(("text", "meta"))])).alias("s"))
        counts: tuple[dict, dict] = ({}, {})
        for c in sides.groupBy("s.k", "s.b").count().collect():
            counts[c["k"]][c["b"]] = c["count"]
        taken = []
        for k, c in enumerate(("text", "meta")):
            says = F.lit(None).cast("double")
            for label, kinds_share, (first, last, n) in zip((0.0, 1.0), (1 - share, share), surest(counts[k], sure_share * (1 - share), sure_share * share), strict=True):
                picked = F.pmod(F.xxhash64("h", F.lit(20 + r)), F.lit(1 << 30)) <= int(min(1.0, most_sure * kinds_share / max(1, n)) * (1 << 30))
                says = F.when(F.col("b")[c].between(first, last) & picked, label).otherwise(says)
            taken.append(says.alias(f"says{k}"))
        sure = scored.select("h", "text", "meta", *taken).filter("says0 is not null or says1 is not null").groupBy("h").agg(*[F.min(c).alias(c) for c in ("text", "meta", "says0", "says1")])
        for found in sure.collect():
            for k in (0, 1):
                if found[f"says{k}"] is not None:
                    more[1 - k][found["h"]] = (found, found[f"says{k}"])
    model.both.fit(np.c_[model.text.logit(xs[0][held]), model.meta.logit(xs[1][held])], y[held])
    dropped(sample, others)
    return model


def judged(model: CoModel | None, text: Column, texts: list[Column], numbers: list[Column]) -> Column:
    """(quality, p_text, p_meta) of a text and its metadata."""

    @F.pandas_udf("quality double, p_text double, p_meta double")
    def apply(text: pd.Series, *values: pd.Series) -> pd.DataFrame:
        take_worker("quality")
        rows = [v.astype(object).where(v.notna(), None).tolist() for v in values]
        words, out = text.tolist(), []
        for at in range(0, len(words), 500):  # bounds the feature rows held
            part = words[at : at + 500]
            if model is None:
                p = np.ones((3, len(part)))
            else:
                p = np.stack(model.score(np.array([model.text_row(t or "") for t in part]), np.array([model.meta_row(list(v)) for v in zip(*(r[at : at + 500] for r in rows), strict=True)])))
            p[0, [i for i, t in enumerate(part) if not t]] = 0.0
            out.append(p)
        p = np.concatenate(out, 1) if out else np.zeros((3, 0))
        return pd.DataFrame({"quality": p[0], "p_text": p[1], "p_meta": p[2]})

    return apply(text, *(c.cast("string") for c in texts), *(c.cast("double") for c in numbers))


def score(
    docs: DataFrame, model: CoModel | None, id_col: str = "doc_id", text_col: str = "text",
    meta_cols: tuple[str, ...] = ("lang", "source"), number_cols: tuple[str, ...] = ("n_chars",),
) -> DataFrame:
    """Probability of being good for each row: ``doc_id``, ``quality``, ``p_text``, ``p_meta``.

    Null and empty texts have quality 0; nulls in the metadata count as unknown.
    Without a model every other text has quality 1 (nothing is known against
    it).
    """
    found = judged(model, F.col(text_col), [F.col(c) for c in meta_cols], [F.col(c) for c in number_cols])
    return docs.select(F.col(id_col).alias("doc_id"), found.alias("found")).select("doc_id", "found.quality", "found.p_text", "found.p_meta")
