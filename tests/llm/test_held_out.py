"""Classifiers on labelled rows that they did not learn from, at a size where those are many enough."""

from pathlib import Path
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from lodestone.llm import bpe, linear, quality, toxicity
from lodestone.llm import queries as Q


@pytest.fixture(scope="module")
def larger(spark, sf_dir):
    at = str(Path(sf_dir).parent / "sf0.01")
    return at, Q.table(spark, at, "documents"), Q.table(spark, at, "labels")


def test_quality(larger):
    _, docs, labels = larger
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    got = {r.doc_id: r for r in quality.quality_rules(docs, labels.where(fold != 1)).collect()}
    rows = labels.where((fold == 1) & F.col("quality").isNotNull()).collect()
    right = sum((got[r.doc_id].p_good >= quality.MIN_GOOD) == bool(r.quality) for r in rows) / len(rows)
    base = max(sum(r.quality == y for r in rows) for y in (0, 1)) / len(rows)
    brier = sum((got[r.doc_id].p_good - r.quality) ** 2 for r in rows) / len(rows)
    assert right >= 0.9 and right > base and brier < 0.08


def test_toxicity(spark, larger):
    at, _, labels = larger
    got = {r.doc_id: r for r in Q.op7_toxicity(spark, at).where("held_out").collect()}
    rows = [r for r in labels.collect() if r.doc_id in got and r.toxic is not None]
    toxic, clean = [got[r.doc_id].predicted for r in rows if r.toxic == 1], [got[r.doc_id].predicted for r in rows if r.toxic == 0]
    assert sum(toxic) >= 0.7 * len(toxic) > 0 and sum(clean) <= 0.02 * len(clean)


def test_toxicity_with_planted_misspellings(spark, larger):
    """Held-out rows of both classes with typos made by rule: what has misspelled hits only is toxic, and clean rows stay clean."""
    at, docs, labels = larger
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None and crc32(str(r.doc_id).encode()) % 3 == 1}
    typed = [(-1 - r.doc_id, toxicity.typos(r.text)) for r in docs.collect() if r.doc_id in truth and r.text]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(typed, "doc_id long, text string"))
    got = toxicity.toxicity(both, labels, learn=Q._fold(3) != 1).where("doc_id < 0").collect()
    only = [truth[-1 - r.doc_id] for r in got if not r.n_exact and r.n_misspelled and r.predicted]
    assert len(only) >= 10 and sum(only) >= 0.85 * len(only)
    assert sum(r.predicted for r in got if truth[-1 - r.doc_id] == 0) <= 0.02 * sum(y == 0 for y in truth.values())


def test_language(spark, larger):
    at, docs, _ = larger
    truth = {r.doc_id: r.lang for r in docs.where("lang is not null").collect()}
    got = {r.doc_id: r.lang_pred for r in Q.op8_language(spark, at).where("held_out").collect()}
    known = [i for i in got if i in truth]
    assert sum(got[i] == truth[i] for i in known) >= 0.97 * len(known) > 0


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * (10 if i % 3 else 5000)) for i in range(60)] + [(7, "y"), (7, None), (None, "z")] + [(8, "x" * 10)] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 0), (None, 1), (5, None)], "doc_id long, y int")
    sample = linear.labelled_sample(docs, labels, "y", F.lit(True), 1000, most_bytes=400)
    assert len({i for i, _, _ in sample}) == len(sample) and {t for _, t, _ in sample} == {"x" * 10}
    for y in (0, 1):
        assert 150 <= sum(len(t) for _, t, v in sample if v == y) <= 200
    assert len(linear.labelled_sample(docs, labels, "y", F.lit(True), 5)) == 10


def test_empty_tables(spark, larger):
    _, docs, labels = larger
    none, path, pattern = docs.limit(0), Q.tokenizer_file("byte_bpe_50k.tiktoken"), Q.pattern()
    ids = bpe.encode(none, path, pattern)
    assert toxicity.reject_toxic(none, labels.limit(0)).count() == ids.count() == bpe.decode(ids, path, pattern).count() == 0
