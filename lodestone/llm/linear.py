"""Small linear models over hashed n-gram means: bounded labelled samples, full-batch fits in numpy, whole-text scoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textbuf as T
from .shared import small, written


#: Bytes of text that a labelled sample may have in all.
SAMPLE_BYTES = 24 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: int, most_bytes: int = SAMPLE_BYTES) -> list[tuple[int, str, object]]:
    """Whole texts as (doc_id, text, label): up to ``per_class`` rows of each class, the ones first by a hash of doc_id.

    Bounds: per_class rows of each class, and an equal share of ``most_bytes`` for each
    class; a text of more than a 16th of its class's share, and those after the share is
    used up, are left out. Rows with null id, text or label are no candidates; an id with
    several labels counts with the smallest, one with several texts with the first of them.
    """
    cand = labels.select("doc_id", F.col(label).alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & keep).groupBy("doc_id").agg(F.min("y").alias("y"))
    # rows whose hash lies clearly above the class's per_class-th are left out before ranking, so a rank's task reads little more than per_class rows
    share = F.least(F.lit(1.0), (per_class + 8 * per_class**0.5 + 64) / F.count("*"))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(5), "doc_id"), 11) / F.lit(float(2**53))
    shares = written(cand.groupBy("y").agg(share.alias("share")), "label-shares")
    classes = shares.count()
    near = cand.withColumn("u", u).join(small(shares, classes), "y").where("u <= share")
    ids = near.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy("u", "doc_id"))).where(F.col("r") <= per_class).select("doc_id", "y", "r")
    of_class = most_bytes // max(1, classes)
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= of_class // 16)).join(F.broadcast(ids), "doc_id")  # bound: per_class rows of each class
    rows = rows.groupBy("doc_id", "y", "r").agg(F.min("text").alias("text"))
    used = F.sum(F.octet_length("text")).over(Window.partitionBy("y").orderBy("r"))
    return [(r.doc_id, r.text, r.y) for r in rows.withColumn("used", used).where(F.col("used") <= of_class).orderBy("doc_id").collect()]  # bounded as above


class Features:
    """Hashed groups of n-grams: ``words`` (numbers of words) and ``chars`` (numbers of bytes); each group's value is its mean weight over the text."""

    def __init__(self, words: tuple[int, ...], chars: tuple[int, ...], bits: int):
        self.words, self.chars, self.bits = words, chars, bits
        self.groups = len(words) + len(chars)
        self.size = self.groups << bits

    def index(self, w: T.Words, h: np.ndarray | None = None):
        """For each group: feature indices, and where each text's begin (one more at the end). Char n-grams run over the text and the line end after it."""
        shift, g = T.U64(64 - self.bits), 0
        h = w.hashes() if self.words and h is None else h
        for n in self.words:
            s, at = T.shingles(w, h, n)
            yield ((s >> shift).astype(np.int32) + (g << self.bits)), np.searchsorted(w.doc[at], np.arange(len(w.count) + 1))
            g += 1
        for n in self.chars:
            x = T.byte_ngrams(w.data, n)
            first = np.minimum(np.append(w.doc_start, len(w.data)), len(x))
            x = (x * T.U64(0xD6E8FEB86659FD93)) >> shift
            yield (x.astype(np.int32) + (g << self.bits)), first
            g += 1

    def matrix(self, texts: list[bytes]):
        """Sparse rows of the texts: (row starts, indices, values); values are frequencies within a group."""
        rows, starts = [], [0]
        for t in texts:
            idx, val = [], []
            for x, _ in self.index(T.Words([t])):
                u, c = np.unique(x, return_counts=True)
                idx.append(u)
                val.append(c / max(1, len(x)))
            rows.append((np.concatenate(idx), np.concatenate(val).astype(np.float32)))
            starts.append(starts[-1] + len(rows[-1][0]))
        return np.array(starts), np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])

    def score(self, w: T.Words, weights: np.ndarray, bias: np.ndarray, h: np.ndarray | None = None) -> np.ndarray:
        """Texts x models: bias plus the groups' mean weights; ``weights`` is (size, models)."""
        total = np.tile(bias.astype(np.float64), (len(w.count), 1))
        for x, first in self.index(w, h):
            n = np.maximum(1, np.diff(first))[:, None]
            for m in range(weights.shape[1]):
                total[:, m] += T.segment_sum(weights[:, m][x], first) / n[:, 0]
        return total


def fit(matrix, y: np.ndarray, size: int, loss: str = "log", steps: int = 60, rate: float = 2.0, l2: float = 1e-6, pick: np.ndarray | None = None):
    """Weights and bias by full-batch Adagrad for y in {0, 1}; both classes weigh the same. loss: log or hinge. pick: rows to use."""
    starts, idx, val = matrix
    if pick is not None:
        take = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in pick]) if len(pick) else np.zeros(0, int)
        starts, idx, val, y = np.concatenate(([0], np.cumsum(np.diff(starts)[pick]))), idx[take], val[take], y[pick]
    used, local = np.unique(idx, return_inverse=True)
    row = np.repeat(np.arange(len(y)), np.diff(starts))
    s = np.where(y > 0, 1.0, -1.0)
    cost = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    w, seen, b, seen_b = np.zeros(len(used)), np.full(len(used), 1e-12), 0.0, 1e-12
    for _ in range(steps):
        m = s * (np.bincount(row, val * w[local], len(y)) + b)
        g = -s * cost * (1 / (1 + np.exp(np.clip(m, -30, 30))) if loss == "log" else (m < 1))
        gw, gb = np.bincount(local, val * g[row], len(used)) + l2 * w, g.sum()
        seen += gw * gw
        seen_b += gb * gb
        w -= rate * gw / np.sqrt(seen)
        b -= 0.1 * gb / np.sqrt(seen_b)
    full = np.zeros(size, np.float32)
    full[used] = w
    return full, b


def margins(matrix, weights: np.ndarray, bias: float) -> np.ndarray:
    starts, idx, val = matrix
    return np.bincount(np.repeat(np.arange(len(starts) - 1), np.diff(starts)), val * weights[idx], len(starts) - 1) + bias


def platt(m: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))) by Newton steps on smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(1e-9, np.abs(m).mean())
    x, a, b = m / scale, 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        v = p * (1 - p) + 1e-9
        g = np.array([((p - t) * x).sum() + 1e-3 * a, (p - t).sum()])
        hess = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-9]])
        d = np.linalg.solve(hess, g)
        a, b = a - d[0], b - d[1]
        if abs(d).max() < 1e-8:
            break
    return max(a, 1e-6) / scale, b


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
