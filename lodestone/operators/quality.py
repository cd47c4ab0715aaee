"""Data-quality checks: every rule is one Column, a set of rules one aggregate over one scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .ranges import beside, quantiles


def missing(c: Column, mode: str = "strict") -> Column:
    """strict (null), empty (and ""), blank (and white space), zero (and zeros)."""
    s = c.cast("string")
    out = c.isNull()
    if mode in ("empty", "blank", "zero"):
        out = out | (s == "")
    if mode in ("blank", "zero"):
        out = out | (F.trim(s) == "")
    if mode == "zero":
        out = out | s.isin("0", "0.0", "0,0")
    return F.coalesce(out, F.lit(False))


def check(df: DataFrame, rules: dict[str, Column], where: dict[str, Column] | None = None) -> DataFrame:
    """rule, evaluated, failed, score for each rule (true is a pass; null counts as failed). ``where``: rows that a rule applies to."""
    where = where or {}
    aggs = []
    for i, (name, ok) in enumerate(rules.items()):
        of = where.get(name, F.lit(True))
        aggs += [F.count_if(of).alias(f"e{i}"), F.count_if(of & ~F.coalesce(ok, F.lit(False))).alias(f"f{i}")]
    rows = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"e{i}").alias("evaluated"), F.col(f"f{i}").alias("failed"), F.coalesce(1 - F.try_divide(F.col(f"f{i}"), F.col(f"e{i}")), F.lit(1.0)).alias("score")) for i, n in enumerate(rules)))
    return df.agg(*aggs).select(F.inline(rows))


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule for each rule that a row breaks."""
    broken = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()))
    return df.select(key, F.explode(F.array_compact(broken)).alias("rule"))


def duplicates(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The (normalised) keys that occur more than once, with n; keys with a null are left out."""
    named = [c.alias(n) for n, c in keys.items()]
    return df.select(*named).dropna().groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def deduplicate(df: DataFrame, keys: list[Column], order: list, keep: str = "first") -> DataFrame:
    """One row of each group of equal keys (nulls are equal): the first or last by ``order``, or all with ``is_duplicate`` (keep="mark")."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(o) if keep == "last" else F.asc(o) for o in order))
    out = df.withColumn("_rn", F.row_number().over(w))
    return out.withColumn("is_duplicate", F.col("_rn") > 1).drop("_rn") if keep == "mark" else out.where("_rn = 1").drop("_rn")


def merge_duplicates(df: DataFrame, keys: list[str], order: str, rules: dict[str, str]) -> DataFrame:
    """One row for each key; a column by its rule: first_non_null, last_non_null, max, min, sum, set, concat."""
    def one(c: str, rule: str) -> Column:
        at = F.when(F.col(c).isNotNull(), F.col(order))
        f = {"first_non_null": lambda: F.min_by(c, at), "last_non_null": lambda: F.max_by(c, at), "max": lambda: F.max(c), "min": lambda: F.min(c), "sum": lambda: F.sum(c), "set": lambda: F.sort_array(F.collect_set(c)), "concat": lambda: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",")}
        return f[rule]().alias(c)

    return df.groupBy(*keys).agg(*(one(c, r) for c, r in rules.items()))


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, nulls, rate, distinct of each column, from one scan."""
    aggs = [F.count("*").alias("n")] + [f for i, c in enumerate(columns) for f in (F.count(c).alias(f"c{i}"), F.count_distinct(c).alias(f"d{i}"))]
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col("n").alias("n"), (F.col("n") - F.col(f"c{i}")).alias("nulls"), F.try_divide(F.col("n") - F.col(f"c{i}"), F.col("n")).alias("rate"), F.col(f"d{i}").alias("distinct")) for i, c in enumerate(columns)))
    return df.agg(*aggs).select(F.inline(rows))


def null_patterns(df: DataFrame, columns: list[str]) -> DataFrame:
    """pattern (1 for null, in the columns' order), n."""
    return df.groupBy(F.concat(*(F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns)).alias("pattern")).agg(F.count("*").alias("n"))


def freshness(df: DataFrame, ts: str, now: Column, by: list[str] = ()) -> DataFrame:
    """by, n, newest, age_seconds."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.max(ts).alias("newest"), (F.unix_timestamp(now) - F.unix_timestamp(F.max(ts))).alias("age_seconds"))


def sequence_gaps(df: DataFrame, by: list[str], number: str, step: int = 1) -> DataFrame:
    """by, before, after: neighbouring numbers of a group that are further apart than the step."""
    w = Window.partitionBy(*by).orderBy(number)
    return df.where(F.col(number).isNotNull()).select(*by, F.lag(number).over(w).alias("before"), F.col(number).alias("after")).where(F.col("after") - F.col("before") > step)


def reconcile(a: DataFrame, b: DataFrame, key: str, value_a: str, value_b: str, tolerance: float) -> DataFrame:
    """key, a, b, delta where the sums of both sides differ by more than the tolerance; a missing side counts as 0."""
    x = a.groupBy(key).agg(F.sum(value_a).alias("a"))
    y = b.groupBy(key).agg(F.sum(value_b).alias("b"))
    out = x.join(y, key, "full").select(key, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in "ab"))
    return out.withColumn("delta", F.col("a") - F.col("b")).where(F.abs("delta") > tolerance)


def checksum(df: DataFrame, columns: list[str]) -> DataFrame:
    """n and a checksum of the rows in any order."""
    return df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*columns)).alias("checksum"))


def outlier_bounds(df: DataFrame, by: list[str], value: str, method: str = "iqr", k: float = 1.5) -> DataFrame:
    """by, low, high. iqr, zscore (population), mad (modified z of 0.6745) or percentile (k is the tail's share)."""
    c = F.col(value)
    if method == "iqr":
        q1, q3 = F.col("q1"), F.col("q3")
        return quantiles(df, by, c, {"q1": 0.25, "q3": 0.75}).select(*by, (q1 - k * (q3 - q1)).alias("low"), (q3 + k * (q3 - q1)).alias("high"))
    if method == "zscore":
        return df.groupBy(*by).agg((F.avg(c) - k * F.stddev_pop(c)).alias("low"), (F.avg(c) + k * F.stddev_pop(c)).alias("high"))
    if method == "percentile":
        return quantiles(df, by, c, {"low": k, "high": 1 - k})
    if method != "mad":
        raise ValueError(f"unknown method {method!r}")
    mid = cut(quantiles(df, by, c, {"_m": 0.5}), "medians")
    dev = quantiles(beside(df, mid, by), by, F.abs(c - F.col("_m")), {"_d": 0.5})
    spread = F.col("_d") * k / 0.6745
    return beside(mid, dev, by).select(*by, (F.col("_m") - spread).alias("low"), (F.col("_m") + spread).alias("high"))


def outliers(df: DataFrame, by: list[str], value: str, method: str = "iqr", k: float = 1.5, action: str = "mark") -> DataFrame:
    """Rows outside their group's bounds: marked (``is_outlier``), dropped, clipped or made null."""
    bounds = outlier_bounds(df, by, value, method, k)
    out = df.join(bounds, by, "left") if by else df.crossJoin(F.broadcast(bounds))
    c = F.col(value)
    bad = F.coalesce((c < F.col("low")) | (c > F.col("high")), F.lit(False))
    done = {"mark": lambda: out.withColumn("is_outlier", bad), "drop": lambda: out.where(~bad), "clip": lambda: out.withColumn(value, F.greatest(F.least(c, "high"), "low")), "null": lambda: out.withColumn(value, F.when(~bad, c))}
    return done[action]().drop("low", "high")


def weighted_score(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """weighted, mean, minimum and harmonic mean of the rules' scores; a rule without a weight has 1."""
    w = reduce(lambda acc, kv: acc.when(F.col("rule") == kv[0], kv[1]), weights.items(), F.when(F.lit(False), 0.0)).otherwise(1.0)
    s = F.col("score")
    return scores.agg((F.sum(s * w) / F.sum(w)).alias("weighted"), F.avg(s).alias("mean"), F.min(s).alias("minimum"), F.try_divide(F.count_if(s > 0), F.sum(F.when(s > 0, 1 / s))).alias("harmonic"))
