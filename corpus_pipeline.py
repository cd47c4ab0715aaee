"""Training-corpus pipeline: toxic documents out, one of each near-duplicate group, personal data sanitised, sources mixed, encoded.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read again for the next.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, mixing, pii, toxicity
from lodestone.llm.ngram_join import near_duplicates
from lodestone.llm.queries import pattern, table, tokenizer_file
from lodestone.llm.shared import written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.replicate(docs).drop("copy", "shuffle_key")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, tokenizer_file("byte_bpe_50k.tiktoken"), pattern())


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_join", one_of_each_group),
    ("pii", sanitise),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: The stages learn from labels, estimate disclosure and use a tokenizer: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
