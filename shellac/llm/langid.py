"""Language identification by a byte convolutional network, in numpy.

Bytes are embedded, filters of several widths run over them, each filter's
maximum over a window is taken, and a softmax over the learned languages
follows.  The network is trained on windows of labelled text and applied to
batches of fixed-length windows that cover every byte of a text; a text's
probabilities are the mean over its windows, weighted by their letters.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_size, take_worker

#: Letters, and numerals such as fractions and Roman ones, which ``isalpha`` tells apart.
WORD_SIGN = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


@dataclass
class ByteNet:
    """Parameters and passes of the network."""

    labels: list[str]
    width: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    dims: int = 8
    seed: int = 7
    p: dict = field(default_factory=dict)

    def __post_init__(self):
        r = np.random.default_rng(self.seed)
        self.p["e"] = r.normal(0, 0.5, (256, self.dims)).astype(np.float32)
        self.p["e"][0] = 0
        for w in self.widths:
            self.p[f"k{w}"] = r.normal(0, (w * self.dims) ** -0.5, (w * self.dims, self.filters)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(self.filters, np.float32)
        n = self.filters * len(self.widths)
        self.p["w"] = r.normal(0, n**-0.5, (n, len(self.labels))).astype(np.float32)
        self.p["c"] = np.zeros(len(self.labels), np.float32)

    def _columns(self, x: np.ndarray, w: int) -> np.ndarray:
        n, length, d = x.shape
        s = x.strides
        return np.lib.stride_tricks.as_strided(x, (n, length - w + 1, w * d), s, writeable=False).reshape(-1, w * d)

    def pooled(self, data: np.ndarray, keep: bool = False):
        """Max-pooled filters of windows (n, width) of bytes; with ``keep`` what training needs too."""
        x = np.ascontiguousarray(self.p["e"][data])
        out, saved = [], []
        for w in self.widths:
            cols = self._columns(x, w)
            h = (cols @ self.p[f"k{w}"]).reshape(len(data), -1, self.filters)
            if keep:
                at = h.argmax(1)
                top = np.take_along_axis(h, at[:, None], 1)[:, 0] + self.p[f"b{w}"]
                saved.append((cols.reshape(len(data), -1, cols.shape[1]), at, top))
            else:
                top = h.max(1) + self.p[f"b{w}"]
            out.append(np.maximum(top, 0))
        return np.concatenate(out, 1), saved

    def predict(self, data: np.ndarray) -> np.ndarray:
        z = self.pooled(data)[0] @ self.p["w"] + self.p["c"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, data: np.ndarray, y: np.ndarray, steps: int = 400, batch: int = 64, rate: float = 4e-3) -> None:
        """Adam on the cross entropy; a window loses a random tail at times, so that short texts are known."""
        r = np.random.default_rng(self.seed + 1)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            pick = r.integers(0, len(data), batch)
            x = data[pick].copy()
            for row in np.flatnonzero(r.random(batch) < 0.4):
                x[row, int(r.integers(8, self.width)) :] = 0
            h, saved = self.pooled(x, keep=True)
            z = h @ self.p["w"] + self.p["c"]
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[np.arange(batch), y[pick]] -= 1
            z /= batch
            g = {"w": h.T @ z, "c": z.sum(0), "e": np.zeros_like(self.p["e"])}
            dh = z @ self.p["w"].T
            for i, w in enumerate(self.widths):
                cols, at, top = saved[i]
                d = dh[:, i * self.filters : (i + 1) * self.filters] * (top > 0)
                picked = cols[np.arange(batch)[:, None], at]
                g[f"k{w}"] = np.einsum("nf,nfc->cf", d, picked)
                g[f"b{w}"] = d.sum(0)
                back = d[:, :, None] * self.p[f"k{w}"].T[None]
                for j in range(w):
                    np.add.at(g["e"], x[np.arange(batch)[:, None], at + j], back[:, :, j * self.dims : (j + 1) * self.dims])
            for k, v in g.items():
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.999 * s[k] + 0.001 * v * v
                self.p[k] -= rate * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step) * m[k] / (np.sqrt(s[k]) + 1e-8)
            self.p["e"][0] = 0


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", per_label: int = 600, most_labels: int | None = None, width: int = 256, steps: int = 400) -> ByteNet | None:
    """Train on a bounded sample of labelled rows, about ``per_label`` windows of each label.

    Rows are chosen by a hash of id and text, each gives the window in the
    middle of its text.  All labels are learned, or the ``most_labels`` most
    frequent ones: the sample and the last layer grow with them.  Rows without text or label are left out; None without any row.
    """
    rows = labelled.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h")).filter("label is not null and text is not null and length(text) > 0")
    tally = rows.groupBy("label").count().orderBy(F.desc("count"), "label")
    counts = {r["label"]: r["count"] for r in (tally.limit(most_labels) if most_labels else tally).collect()}
    if not counts:
        return None
    shares = rows.sparkSession.createDataFrame([(k, int(min(1.0, per_label / n) * (1 << 30))) for k, n in counts.items()], "label string, share long")
    middle = F.substring("text", F.greatest(F.lit(1), (F.length("text") / 2).cast("int") - width // 2), F.lit(width))
    sample = rows.join(F.broadcast(shares), "label").filter(F.pmod("h", F.lit(1 << 30)) <= F.col("share")).select("label", middle.alias("text"), "h").limit(2 * per_label * len(counts)).collect()
    sample.sort(key=lambda r: (r["label"], r["h"]))
    labels = sorted({r["label"] for r in sample})
    net = ByteNet(labels, width=width)
    data = np.zeros((len(sample), width), np.uint8)
    for i, r in enumerate(sample):
        b = r["text"].encode()[:width]
        data[i, : len(b)] = np.frombuffer(b, np.uint8)
    # every label counts alike, whatever its share of the sample
    y = np.array([labels.index(r["label"]) for r in sample])
    per = [np.flatnonzero(y == k) for k in range(len(labels))]
    even = np.concatenate([np.resize(p, max(map(len, per))) for p in per])
    net.fit(data[even], y[even], steps=steps)
    return net


def windows(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts and how many each text has; the last window of a text is padded with zeros."""
    counts = np.array([-(-len(t) // width) for t in texts], np.int64)
    data = b"".join(t.ljust(int(n) * width, b"\0") for t, n in zip(texts, counts, strict=True))
    return np.frombuffer(data, np.uint8).reshape(-1, width), counts


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in WORD_SIGN.finditer(text))


def label_texts(net: ByteNet | None, texts: list[str | None], run: int = 512) -> tuple[list[str], list[float]]:
    """Language and score of each text; memory is bounded by the texts and ``run`` windows."""
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if net and t and has_letter(t)]
    for part in by_size(known, (len(texts[i]) for i in known), 1 << 20):
        data, counts = windows([texts[i].encode() for i in part], net.width)
        # bytes of letters: ASCII letters and all of the other scripts' bytes
        weight = (((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128)).sum(1) + 1e-3
        probs = np.concatenate([net.predict(data[i : i + run]) for i in range(0, len(data), run)])
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        total = np.add.reduceat(probs * weight[:, None], starts) / np.add.reduceat(weight, starts)[:, None]
        for i, row in zip(part, total, strict=True):
            best = int(row.argmax())
            langs[i], scores[i] = net.labels[best], float(min(1.0, max(0.0, row[best])))
    return langs, scores


def language(net: ByteNet | None, text: Column) -> Column:
    """(lang_pred, score) of a text column."""

    @F.pandas_udf("lang_pred string, score double")
    def apply(texts: pd.Series) -> pd.DataFrame:
        take_worker("langid")
        langs, scores = label_texts(net, texts.tolist())
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return apply(text)


def identify(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every whole text: ``doc_id``, ``lang_pred``, ``score`` (its probability).

    One row for each row, repeated ones and null ids included; an empty table
    gives none; other columns are not read.  ``und`` with score 0 if the text is
    null or has no letter (digits, fractions and Roman numerals are none), or if
    there is no network.
    """
    return docs.select(F.col(id_col).alias("doc_id"), language(net, F.col(text_col)).alias("found")).select("doc_id", "found.lang_pred", "found.score")
