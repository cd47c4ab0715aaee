"""Aggregation from small specs: one shuffle for any number of measures, partial aggregates on the map side."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Agg:
    """A measure: ``kind`` over ``field``, named ``name``. ``order`` for first and last, ``weight`` for a weighted mean, ``p`` for a percentile (0 to 1), ``limit`` for lists (all members without one). ``nulls``: ignore, or zero."""

    name: str
    kind: str
    field: str | None = None
    order: str | None = None
    weight: str | None = None
    p: float = 0.95
    limit: int | None = None
    nulls: str = "ignore"


def measure(a: Agg) -> Column:
    c = F.col(a.field) if a.field else F.lit(1)
    c = F.coalesce(c, F.lit(0)) if a.nulls == "zero" else c
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    present = F.when(c.isNotNull(), F.col(a.order) if a.order else F.lit(None))
    kinds = {
        "count": lambda: F.count(F.lit(1)),
        "count_non_null": lambda: F.count(c),
        "sum": lambda: zero(F.sum(c.cast("double"))),
        "min": lambda: F.min(c),
        "max": lambda: F.max(c),
        "avg": lambda: F.avg(c),
        "median": lambda: F.percentile(c, F.lit(0.5)),
        "percentile": lambda: F.percentile(c, F.lit(a.p)),
        "count_distinct": lambda: F.count_distinct(c),
        "first": lambda: F.min_by(c, present),
        "last": lambda: F.max_by(c, present),
        "variance": lambda: zero(F.var_samp(c)),
        "stddev": lambda: zero(F.stddev_samp(c)),
        "stddev_pop": lambda: F.stddev_pop(c),
        "set": lambda: F.sort_array(F.collect_set(c)) if a.limit is None else F.slice(F.sort_array(F.collect_set(c)), 1, a.limit),
        "weighted_avg": lambda: F.try_divide(F.sum(c * F.col(a.weight)), F.sum(F.when(c.isNotNull(), F.col(a.weight)))),
        "mode": lambda: F.mode(c, True),
    }
    if a.kind not in kinds:
        raise ValueError(f"unknown aggregate {a.kind!r}")
    return kinds[a.kind]().alias(a.name)


def aggregate(df: DataFrame, by: list[str], aggs: list[Agg], having: Column | None = None) -> DataFrame:
    """Groups (null is a group of its own) and their measures. Sums of nothing are 0, deviations of fewer than two values 0."""
    out = df.groupBy(*by).agg(*map(measure, aggs))
    return out if having is None else out.where(having)


def with_totals(df: DataFrame, by: list[str], aggs: list[Agg]) -> DataFrame:
    """Groups and the grand total in one pass; ``is_total`` marks the latter."""
    return df.rollup(*by).agg(*map(measure, aggs), F.grouping_id().alias("_g")).where(F.col("_g").isin(0, 2 ** len(by) - 1)).withColumn("is_total", F.col("_g") != 0).drop("_g")


def top_with_other(df: DataFrame, key: str, value: str, n: int, other: str = "other") -> DataFrame:
    """key, total: the n keys with the largest sums (ties by key), the rest summed into one row. Ranks are taken over the pre-aggregated keys."""
    sums = df.groupBy(F.col(key).cast("string").alias("key")).agg(F.sum(value).alias("total"))
    top = sums.orderBy(F.desc("total"), "key").limit(n).select("key", F.lit(True).alias("_top"))
    return sums.join(F.broadcast(top), "key", "left").groupBy(F.when(F.col("_top"), F.col("key")).otherwise(other).alias("key")).agg(F.sum("total").alias("total"))


def breakdown(df: DataFrame, dims: list[str], value: str) -> DataFrame:
    """dimension, member, total, share for each dimension alone, in one scan (grouping sets)."""
    each = df.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("member")) for d in dims))).alias("x"), F.col(value).alias("v"))
    sums = each.groupBy("x.dimension", "x.member").agg(F.sum("v").alias("total"))
    return sums.withColumn("share", F.try_divide(F.col("total"), F.sum("total").over(Window.partitionBy("dimension"))))


def frequencies(df: DataFrame, field: str) -> DataFrame:
    """value, n, share of each value."""
    n = df.groupBy(F.col(field).cast("string").alias("value")).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("_all")))).select("value", "n", (F.col("n") / F.col("_all")).alias("share"))


def entropy(df: DataFrame, field: str) -> DataFrame:
    """distinct values, mode and Shannon entropy in bits of a column's non-null values."""
    n = df.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("v")).agg(F.count("*").alias("n"))
    t = n.agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    return n.crossJoin(F.broadcast(t)).agg(F.count("*").alias("n_distinct"), F.max_by("v", F.struct("n", F.col("v"))).alias("mode"), F.coalesce(-F.sum(p * F.log2(p)), F.lit(0.0)).alias("entropy"))


def histogram(df: DataFrame, field: str, bins: int) -> DataFrame:
    """bin, low, high, n, share, cumulative: equal widths, the last bin closed; a constant column has one bin."""
    c = F.col(field).cast("double")
    ends = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(c).alias("t"))
    width = (F.col("hi") - F.col("lo")) / bins
    which = F.when(width > 0, F.least(F.floor((c - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    n = df.where(c.isNotNull()).crossJoin(F.broadcast(ends)).groupBy(which.alias("bin")).agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("t").alias("t"))
    w = (F.col("hi") - F.col("lo")) / bins
    running = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # at most ``bins`` rows
    return n.select("bin", (F.col("lo") + w * F.col("bin")).alias("low"), F.when(w > 0, F.col("lo") + w * (F.col("bin") + 1)).otherwise(F.col("hi")).alias("high"), "n", (F.col("n") / F.col("t")).alias("share"), (F.sum("n").over(running) / F.col("t")).alias("cumulative"))


def compare_periods(current: DataFrame, previous: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, current, previous, delta, pct (against the previous value's size), trend up / down / flat; keys of either side."""
    a = current.groupBy(*keys).agg(F.sum(value).alias("current"))
    b = previous.groupBy(*keys).agg(F.sum(value).alias("previous"))
    out = a.join(b, keys, "full").select(*keys, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("current", "previous")))
    d = F.col("current") - F.col("previous")
    return out.select("*", d.alias("delta"), F.try_divide(d * 100, F.abs("previous")).alias("pct"), F.when(d > 1e-9, "up").when(d < -1e-9, "down").otherwise("flat").alias("trend"))
