"""Quality rules: fixed counting rules, then a calibrated logistic regression on hashed word and character n-grams.

The model learns from a bounded sample of labelled rows (``per_class`` of each
class); every whole text is counted and scored in Arrow batches.

Defined cases: null and empty text has no words, so base_failed is true and kept
false; repeated rows and doc_ids are each scored; null doc_id passes through;
without labels of both classes every text gets p_good 1; other columns of the
inputs are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf as T
from .linear import Features, fit, labelled_sample, margins, platt, sigmoid

FEATURES = Features(words=(1, 2), chars=(2, 4), bits=17)
#: Fixed thresholds of the rules.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW, MIN_GOOD = 20, 30, 8, 0.5
SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_CHAR = (np.arange(256) & 0xC0) != 0x80


def train(sample: list[tuple[int, str, object]]):
    """(weights, bias, a, b) from (doc_id, text, quality) rows, or None if a class is missing. Every third row is held out for the calibration."""
    y = np.array([int(r[2]) for r in sample], float)
    if len(set(y.tolist())) < 2:
        return None
    m = FEATURES.matrix([r[1].encode() for r in sample])
    hold = np.zeros(len(y), bool)
    for c in (0, 1):  # alike in both classes
        hold[np.flatnonzero(y == c)[2::3]] = True
    w, b = fit(m, y, FEATURES.size, pick=np.flatnonzero(~hold))
    test = np.flatnonzero(hold) if len(set(y[hold].tolist())) == 2 else np.arange(len(y))
    a, c = platt(margins(m, w, b)[test], y[test])
    return w, b, a, c


def _counts(w: T.Words, h: np.ndarray):
    texts = len(w.count)
    span = lambda flag: (lambda c: c[w.doc_end] - c[w.doc_start])(np.concatenate(([0], np.cumsum(flag, dtype=np.int64))))
    chars = span(_IS_CHAR[w.data] & ~T.IS_SPACE[w.data])
    symbols = span(_IS_SYMBOL[w.data])
    # lines with a word, by their whole bytes
    end = np.flatnonzero(w.data == 10)
    start = np.concatenate(([0], end[:-1] + 1)) if len(end) else end
    has = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    line = T.Words.__new__(T.Words)
    line.data, line.start, line.end = w.data, start[has], end[has]
    doc = np.searchsorted(w.doc_end, line.end)
    _, at = np.unique(T.mix(line.hashes() ^ T.mix(doc.astype(np.uint64) + T.U64(1))), return_index=True)
    dup = np.bincount(doc, minlength=texts) - np.bincount(doc[at], minlength=texts)
    s, at = T.shingles(w, h, WINDOW)
    _, back, n = np.unique(T.mix(s ^ T.mix(w.doc[at].astype(np.uint64) + T.U64(1))), return_inverse=True, return_counts=True)
    again = at[n[back] > 1]
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + WINDOW, -1)
    repeat = np.bincount(w.doc, np.cumsum(edge[:-1]) > 0, texts).astype(np.int64)
    return chars, symbols, dup, repeat


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, p_good double, kept boolean"


def score_batches(model):
    def run(batches):
        fitted = model.value
        for cut, texts in T.pieces(batches, most=1 << 19):
            w = T.Words(texts)
            h = w.hashes()
            chars, symbols, dup, repeat = _counts(w, h)
            n = w.count.astype(np.int64)
            failed = (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)
            p = np.ones(len(n)) if fitted is None else sigmoid(fitted[2] * FEATURES.score(w, fitted[0][:, None], np.array([fitted[1]]), h)[:, 0] + fitted[3])
            yield pa.RecordBatch.from_arrays([cut.column(0).cast(pa.int64()), *map(pa.array, (n, chars, symbols, dup.astype(np.int64), repeat, failed, p, ~failed & (p >= MIN_GOOD)))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return run


def quality_rules(docs: DataFrame, labels: DataFrame, per_class: int = 1000) -> DataFrame:
    """One row per row of docs with the counts, base_failed, p_good and kept. per_class bounds the training sample."""
    model = docs.sparkSession.sparkContext.broadcast(train(labelled_sample(docs, labels, "quality", F.lit(True), per_class)))
    return docs.select("doc_id", "text").mapInArrow(score_batches(model), SCHEMA)
