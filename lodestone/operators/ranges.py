"""Places, ranks and quantiles of rows within groups, however few and large the groups are: rows are dealt to range partitions of which only the counts meet, quantiles are bracketed by sketches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def numbered(df: DataFrame, by: list[str], order: list[str], place: str = "_i", size: str = "_n") -> DataFrame:
    """df with ``place`` (from 0) in the group's order and ``size``, the group's rows. Ties keep the order of the range sort; nulls come first, and null keys are a group."""
    keys = [F.asc_nulls_first(c) for c in (*by, *order)]
    dealt = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    names = [f"_k{i}" for i in range(len(by))]
    part = F.shiftright("_at", 33).alias("_part")
    counts = dealt.groupBy(*(F.col(b).alias(k) for b, k in zip(by, names, strict=True)), part).agg(F.count("*").alias("_c"), F.min("_at").alias("_first"))
    group = Window.partitionBy(*names)  # a row for each partition that the group is in
    before = F.coalesce(F.sum("_c").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = cut(counts.select(*names, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_c").over(group).alias(size)), "range-counts")
    on = F.shiftright(dealt["_at"], 33) == counts["_part"]
    for b, k in zip(by, names, strict=True):
        on &= dealt[b].eqNullSafe(counts[k])
    return dealt.join(counts, on).withColumn(place, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift", *names)


def beside(df: DataFrame, extra: DataFrame, by: list[str]) -> DataFrame:
    """df with the columns of ``extra``, which has at most a row for each key; null keys meet as well."""
    if not by:
        return df.crossJoin(extra)  # one row
    named = extra.select(*(F.col(b).alias(f"_b{i}") for i, b in enumerate(by)), *(c for c in extra.columns if c not in by))
    on = F.lit(True)
    for i, b in enumerate(by):
        on &= F.col(b).eqNullSafe(F.col(f"_b{i}"))
    return df.join(named, on, "left").drop(*(f"_b{i}" for i in range(len(by))))


def quantiles(df: DataFrame, by: list[str], value: Column, shares: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """by and a column for each share (0 to 1): the exact quantile, linear between neighbours, of the group's non-null values. Groups without any are absent.

    A sketch of each group brackets the wanted places within 1 / accuracy of its rows. A
    second scan counts: values inside a bracket one by one, what lies between brackets as
    one entry with its least and largest value. Counts are combined before the shuffle, so
    no rows move but those few, and the entries' running sums tell the exact values.
    """
    rows = df.select(*by, value.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    e = 2.0 / accuracy
    ends = [x for p in shares.values() for x in (max(0.0, p - e), min(1.0, p + e))]
    brackets = cut(rows.groupBy(*by).agg(F.percentile_approx("_v", F.array(*map(F.lit, ends)), accuracy).alias("_p")), "brackets")
    v, pairs = F.col("_v"), [(F.col("_p")[2 * i], F.col("_p")[2 * i + 1]) for i in range(len(shares))]
    inside, gap = F.lit(False), F.lit(0)
    for lo, hi in pairs:
        inside |= (v >= lo) & (v <= hi)
        gap += (v >= lo).cast("int") + (v > hi).cast("int")
    placed = beside(rows, brackets, by).select(*by, v, F.when(inside, v).alias("_one"), F.when(~inside, gap).alias("_gap"))
    entries = placed.groupBy(*by, "_one", "_gap").agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_c").over(group.orderBy("_lo").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    entries = entries.withColumns({"_s": before, "_n": F.sum("_c").over(group)})

    def at(place: Column) -> Column:
        """The value at a place, where the entry has it."""
        own = (place >= F.col("_s")) & (place < F.col("_s") + F.col("_c"))
        known = F.when((F.col("_lo") == F.col("_hi")) | (place == F.col("_s")), F.col("_lo")).when(place == F.col("_s") + F.col("_c") - 1, F.col("_hi")).otherwise(F.raise_error(F.lit("a place lies between brackets")).cast("double"))
        return F.max(F.when(own, known))

    aggs = []
    for i, p in enumerate(shares.values()):
        x = (F.col("_n") - 1) * F.lit(float(p))
        aggs += [at(F.floor(x)).alias(f"_a{i}"), at(F.ceil(x)).alias(f"_b{i}"), F.max(x - F.floor(x)).alias(f"_w{i}")]
    out = entries.groupBy(*by).agg(*aggs)
    out = out.select(*by, *((F.col(f"_a{i}") * (1 - F.col(f"_w{i}")) + F.col(f"_b{i}") * F.col(f"_w{i}")).alias(name) for i, name in enumerate(shares)))
    return out if by else out.where(" OR ".join(f"`{name}` IS NOT NULL" for name in shares))


def average_ranks(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """df with the average rank (from 1) of the value within its group; equal values share theirs. Counted values are numbered, not rows."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_m"))
    rows = numbered(counts, by, [value])
    # running sums of the counts in two levels: blocks of values, then the values of a block
    block = F.floor(F.col("_i") / 4096)
    rows = cut(rows.withColumn("_b", block), "rank-values")
    sums = rows.groupBy(*by, "_b").agg(F.sum("_m").alias("_s"))
    start = sums.select(*by, "_b", F.coalesce(F.sum("_s").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s0"))
    inside = Window.partitionBy(*by, "_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    keyed = rows.withColumn("_w", F.coalesce(F.sum("_m").over(inside), F.lit(0))).join(_renamed(start, by), _same(rows, by) & (F.col("_b") == F.col("_rb")))
    ranks = keyed.select(*(F.col(b).alias(f"_x{i}") for i, b in enumerate(by)), F.col(value).alias("_xv"), (F.col("_s0") + F.col("_w") + (F.col("_m") + 1) / 2).alias(name))
    on = df[value].eqNullSafe(F.col("_xv"))
    for i, b in enumerate(by):
        on &= df[b].eqNullSafe(F.col(f"_x{i}"))
    return df.join(ranks, on).drop("_xv", *(f"_x{i}" for i in range(len(by))))


def _renamed(df: DataFrame, by: list[str]) -> DataFrame:
    return df.select(*(F.col(b).alias(f"_r{i}") for i, b in enumerate(by)), F.col("_b").alias("_rb"), "_s0")


def _same(rows: DataFrame, by: list[str]) -> Column:
    on = F.lit(True)
    for i, b in enumerate(by):
        on &= rows[b].eqNullSafe(F.col(f"_r{i}"))
    return on


def sketch_error(k: int = 200) -> float:
    """The normalised rank error that a KLL sketch of size k keeps with 99 % probability."""
    return 2.296 / k**0.9021 if k >= 8 else math.inf
