"""Ranking and chunking of texts in native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def word_list(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def keyword_score(text: Column, words: Column, query: str) -> Column:
    """0.75 of the share of query words found, 0.10 of their density, 0.15 if the whole query occurs, at most 1; 0 for a text without words."""
    wanted = sorted({w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split()})
    if not wanted:
        return F.lit(0.0)
    terms = F.array(*map(F.lit, wanted))
    overlap = F.size(F.array_intersect(terms, words)) / F.lit(float(len(wanted)))
    hits = F.size(F.filter(words, lambda w: F.array_contains(terms, w)))
    density = hits / F.greatest(F.lit(1), F.size(words))
    phrase = F.when(F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(query.lower())), 1.0).otherwise(0.0)
    return F.when(F.size(words) > 0, F.least(F.lit(1.0), 0.75 * overlap + 0.10 * density + 0.15 * phrase)).otherwise(0.0)


def ranked(df: DataFrame, key: str, score: Column, k: int, least: float = 0.0) -> DataFrame:
    """The k best rows by score, then key: key, score, rank. Only k rows reach the ranking task."""
    top = df.select(key, score.alias("score")).where(F.col("score") > least).orderBy(F.desc("score"), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def fused(lists: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: the sum of 1 / (k + rank), divided by the largest."""
    all_lists = lists[0].select(key, "rank")
    for x in lists[1:]:
        all_lists = all_lists.unionByName(x.select(key, "rank"))
    total = all_lists.groupBy(key).agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("s"))
    top = total.agg(F.max("s").alias("top"))
    return total.join(F.broadcast(top)).select(key, (F.col("s") / F.col("top")).alias("score"))  # one row


def chunks(df: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """Windows of ``size`` characters, each beginning ``size - overlap`` after the one before: key, chunk, start, content. The last one ends with the text; an empty text has none."""
    step = size - overlap
    n = F.length(text)
    count = F.when(n > 0, F.greatest(F.lit(1), F.ceil((n - F.lit(overlap)) / F.lit(step))).cast("int")).otherwise(0)
    at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return df.select(key, text, F.explode(at).alias("chunk")).select(key, "chunk", (F.col("chunk") * step).alias("start"), F.substring(F.col(text), F.col("chunk") * step + 1, F.lit(size)).alias("content"))


def paragraphs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Trimmed runs of lines between blank lines: key, paragraph, content."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n[ \t]*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    return df.select(key, F.posexplode(parts).alias("paragraph", "content"))
