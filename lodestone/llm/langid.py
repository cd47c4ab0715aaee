"""Language identification in two steps: the language family, then one-versus-one linear SVMs inside it.

All models are linear over hashed n-grams of 1 to 4 bytes, learned from a bounded
sample of rows with a known language (``per_lang`` each). Families come from the
fixed table below; a language that it lacks is a family of its own.

Defined cases: null text and text without a letter give ``und`` with score 0;
other empty tables give no rows; rows are predicted one by one, so repeated rows
get equal answers; null doc_id passes through with held_out null; no learnable
language gives ``und`` for all; other columns are never read.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbuf as T
from .linear import Features, fit, labelled_sample, margins, sigmoid

#: ISO 639-1 codes by family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af",
    "romance": "fr es pt it ro ca gl",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk",
    "turkic": "tr az kk uz",
    "finnic": "fi et hu",
    "semitic": "ar he mt am",
    "indic": "hi bn ur mr pa gu ne",
    "baltic": "lt lv",
}
_FAMILY = {code: f for f, codes in FAMILIES.items() for code in codes.split()}
FEATURES = Features(words=(), chars=(1, 2, 3, 4), bits=15)
_LETTER = re.compile(r"[^\W\d_]")


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], lang)


class Model:
    """``columns``: one weight column for each binary SVM; families one against the rest, then each pair of languages of a family."""

    def __init__(self, sample: list[tuple[int, str, str]]):
        y = np.array([r[2] for r in sample], object)
        self.langs = sorted(set(y.tolist()))
        self.families = sorted({family(x) for x in self.langs})
        fam = np.array([family(x) for x in y], object)
        m = FEATURES.matrix([r[1].encode() for r in sample]) if sample else None
        weights, bias, self.column = [], [], {}

        def learn(key, target, pick=None):
            w, b = fit(m, target, FEATURES.size, "hinge", pick=pick)
            at = np.arange(len(y)) if pick is None else pick
            spread = np.abs(margins(m, w, b)[at]).mean() + 1e-9  # a margin of 1 is the mean distance of the sample
            self.column[key] = len(weights)
            weights.append(w / spread)
            bias.append(b / spread)

        if len(self.families) > 1:
            for f in self.families:
                learn(f, (fam == f).astype(float))
        self.pairs = [(a, b) for f in self.families for a, b in combinations([x for x in self.langs if family(x) == f], 2)]
        for a, b in self.pairs:
            pick = np.flatnonzero((y == a) | (y == b))
            learn((a, b), (y == a).astype(float), pick)
        self.weights = np.stack(weights, 1).astype(np.float32) if weights else np.zeros((FEATURES.size, 0), np.float32)
        self.bias = np.array(bias)

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        s = FEATURES.score(T.Words(texts), self.weights, self.bias)
        fam = np.argmax(s[:, : len(self.families)], 1) if len(self.families) > 1 else np.zeros(len(texts), int)
        sure = sigmoid(2 * s[np.arange(len(texts)), fam]) if len(self.families) > 1 else np.ones(len(texts))
        out, score = [], np.zeros(len(texts))
        for i, t in enumerate(texts):
            if not self.langs or not _LETTER.search(t.decode("utf-8", "replace")):
                out.append("und")
                continue
            of = [x for x in self.langs if family(x) == self.families[fam[i]]]
            votes, least = dict.fromkeys(of, 0.0), 1.0
            for a, b in combinations(of, 2):
                p = sigmoid(2 * s[i, self.column[a, b]])
                votes[a] += p
                votes[b] += 1 - p
            best = max(of, key=lambda x: (votes[x], x))
            if len(of) > 1:
                least = votes[best] / (len(of) - 1)
            out.append(best)
            score[i] = min(1.0, sure[i] * least)
        return out, score


def identify(docs: DataFrame, learn: Column | None = None, per_lang: int = 400) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs; learns from the rows of docs that ``learn`` keeps and whose lang is known."""
    model = docs.sparkSession.sparkContext.broadcast(Model(labelled_sample(docs, docs, "lang", F.lit(True) if learn is None else learn, per_lang)))

    def run(batches):
        for cut, texts in T.pieces(batches, most=1 << 19):
            lang, score = model.value.predict(texts)
            yield pa.RecordBatch.from_arrays([cut.column(0).cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
