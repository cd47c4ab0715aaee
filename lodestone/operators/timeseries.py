"""Ordered operators: rolling frames, resampling, gaps, sessions, funnels, cohorts, trends. All are window or grouped plans; one shuffle by entity serves each."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import numbered
from .stats import correlation


def _micros(ts: Column) -> Column:
    """Microseconds of either kind of timestamp."""
    return F.unix_micros(ts.cast("timestamp"))


def lag_lead(df: DataFrame, by: list[str], order: list, value: str, lags=(1,), leads=()) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({f"{value}_lag_{k}": F.lag(value, k).over(w) for k in lags} | {f"{value}_lead_{k}": F.lead(value, k).over(w) for k in leads})


def rolling(df: DataFrame, by: list[str], order: list, value: str, size: int, stats=("mean",), min_periods: int = 1, exclude_current: bool = False) -> DataFrame:
    """Statistics over the last ``size`` rows; null while fewer than ``min_periods`` values are in the frame."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-size, -1) if exclude_current else Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - size, 0)
    f = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp, "std_pop": F.stddev_pop, "count": F.count, "median": F.median}
    return df.withColumns({f"{value}_{s}_{size}": F.when(F.count(value).over(w) >= min_periods, f[s](value).over(w)) for s in stats})


def trailing(df: DataFrame, by: list[str], ts: str, seconds: int, aggs: dict[str, Column]) -> DataFrame:
    """Aggregates over rows of the same key at most ``seconds`` before, itself and its ties included."""
    w = Window.partitionBy(*by).orderBy(_micros(F.col(ts))).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumns({name: c.over(w) for name, c in aggs.items()})


def change(df: DataFrame, by: list[str], order: list, value: str, k: int = 1) -> DataFrame:
    before = F.lag(value, k).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumns({f"{value}_diff": F.col(value) - before, f"{value}_pct": F.try_divide(F.col(value), before) - 1})


def running_balance(df: DataFrame, by: list[str], order: list, net: str, opening: float = 0.0) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    closing = F.lit(opening) + F.sum(net).over(w)
    return df.withColumns({"opening": closing - F.col(net), "closing": closing})


def resample(df: DataFrame, by: list[str], ts: str, unit: str, aggs: dict[str, Column], fill: str = "none", value: str | None = None) -> DataFrame:
    """One row per entity and bucket from its first to its last, empty ones included. fill for ``value``: none, zero, ffill, bfill, mean or linear."""
    bucket = F.date_trunc(unit, ts).alias("bucket")
    got = df.groupBy(*by, bucket).agg(*(c.alias(n) for n, c in aggs.items()))
    ends = got.groupBy(*by).agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    spine = ends.select(*by, F.explode(F.expr(f"sequence(lo, hi, interval 1 {unit})")).alias("bucket"))
    out = spine.join(got, [*by, "bucket"], "left")
    if not value or fill == "none":
        return out
    c, w = F.col(value), Window.partitionBy(*by).orderBy("bucket")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    if fill == "zero":
        new = F.coalesce(c, F.lit(0))
    elif fill == "ffill":
        new = F.last(c, ignorenulls=True).over(back)
    elif fill == "bfill":
        new = F.first(c, ignorenulls=True).over(ahead)
    elif fill == "mean":
        new = F.coalesce(c, F.avg(c).over(Window.partitionBy(*by)))
    elif fill == "linear":
        at = F.unix_timestamp("bucket")
        t = F.when(c.isNotNull(), at)
        t0, t1 = F.last(t, ignorenulls=True).over(back), F.first(t, ignorenulls=True).over(ahead)
        v0, v1 = F.last(c, ignorenulls=True).over(back), F.first(c, ignorenulls=True).over(ahead)
        new = F.when(c.isNotNull(), c).otherwise(v0 + (v1 - v0) * (at - t0) / (t1 - t0))
    else:
        raise ValueError(f"unknown fill {fill!r}")
    return out.withColumn(value, new)


def sessions(df: DataFrame, by: str, ts: str, gap_seconds: float, ties: list) -> DataFrame:
    """df with ``session`` (1, 2, ... per entity): a new one where the time since the row before is more than the gap."""
    w = Window.partitionBy(by).orderBy(ts, *ties)
    new = (_micros(F.col(ts)) - _micros(F.lag(ts).over(w))) > F.lit(int(gap_seconds * 1e6))
    return df.withColumn("session", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def funnel(df: DataFrame, by: str, ts: str, event: str, steps: list[str], within_seconds: int, tie: str) -> DataFrame:
    """step, name, users, drop_off: users whose events reach each step in order, greedily, each within the window of the first step's event.

    A step is the least (time, tie) after the step before: rows meet one row per
    user and are pre-aggregated, so no user's events are gathered anywhere.
    """
    at = F.struct(_micros(F.col(ts)).alias("t"), F.col(tie).alias("k"))
    rows = df.where(F.col(event).isin(steps)).select(F.col(by).alias("u"), at.alias("at"), F.col(event).alias("e"))
    reached = rows.where(F.col("e") == steps[0]).groupBy("u").agg(F.min("at").alias("p0"))
    for k, name in enumerate(steps[1:], 1):
        next_ = rows.where(F.col("e") == name).join(reached.select("u", "p0", F.col(f"p{k - 1}").alias("was")), "u")
        ok = (F.col("at") > F.col("was")) & (F.col("at.t") - F.col("p0.t") <= within_seconds * 1_000_000)
        reached = reached.join(next_.where(ok).groupBy("u").agg(F.min("at").alias(f"p{k}")), "u", "left")
    counts = reached.agg(*(F.count(f"p{k}").alias(f"s{k}") for k in range(len(steps))))
    table = F.array(*(F.struct(F.lit(k + 1).alias("step"), F.lit(s).alias("name"), F.col(f"s{k}").alias("users"), (F.lit(0.0) if not k else F.coalesce(1 - F.try_divide(F.col(f"s{k}"), F.col(f"s{k - 1}")), F.lit(0.0))).alias("drop_off")) for k, s in enumerate(steps)))
    return counts.select(F.inline(table))


def cohort_retention(df: DataFrame, by: str, ts: str, periods: int, unit: str = "week") -> DataFrame:
    """cohort, period, users, size, rate: users of a cohort (their first bucket) active that many buckets later."""
    act = df.groupBy(F.col(by).alias("u"), F.date_trunc(unit, ts).alias("b")).agg(F.lit(1).alias("_"))
    act = act.withColumn("cohort", F.min("b").over(Window.partitionBy("u")))
    days = {"day": 1, "week": 7}[unit]
    act = act.withColumn("period", (F.datediff("b", "cohort") / days).cast("int")).where(F.col("period") <= periods)
    n = act.groupBy("cohort", "period").agg(F.count("*").alias("users"))
    size = F.max(F.when(F.col("period") == 0, F.col("users"))).over(Window.partitionBy("cohort"))
    return n.select("cohort", "period", "users", size.alias("size"), (F.col("users") / size).alias("rate"))


def ema(df: DataFrame, by: list[str], order: list[str], value: str, span: int) -> DataFrame:
    """by, i, value, sma, ema of the non-null values: the mean of the last ``span`` values, and the exponential mean seeded with the first full one (alpha 2 / (span + 1)).

    Values so far back that their weight is below double precision are left out
    of the fold, so a row needs a bounded frame, however long the series is.
    """
    alpha = 2 / (span + 1)
    frame = math.ceil(39 / -math.log(1 - alpha)) if span > 1 else 1
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.where(F.col(value).isNotNull()).select(*by, *order, F.col(value).cast("double").alias("value"))
    rows = rows.withColumn("i", F.row_number().over(w) - 1).withColumn("sma", F.when(F.col("i") >= span - 1, F.avg("value").over(w.rowsBetween(1 - span, 0))))
    rows = rows.withColumn("_v", F.collect_list("value").over(w.rowsBetween(1 - frame, 0))).withColumn("_s", F.first("sma", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.least(F.col("i") - (span - 1), F.lit(frame))
    fold = F.aggregate(F.slice(F.col("_v"), F.size("_v") - n + 1, n), F.col("_s"), lambda acc, x: alpha * x + (1 - alpha) * acc)
    return rows.withColumn("ema", F.when(F.col("i") >= span - 1, fold)).drop("_v", "_s", *(o for o in order if o not in by))


def trend(df: DataFrame, by: list[str], order: list, value: str) -> DataFrame:
    """by, n, slope, intercept, r, cv, direction and strength of the least-squares line over the row index (from 0). ``order`` are names of columns."""
    x = numbered(df, by, order).withColumn("_i", F.col("_i").cast("double"))
    y = F.col(value).cast("double")
    r = correlation(F.col("_i"), y)
    out = x.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(y, F.col("_i")).alias("slope"), F.regr_intercept(y, F.col("_i")).alias("intercept"), r.alias("r"), F.try_divide(F.stddev_samp(y), F.abs(F.avg(y))).alias("cv"))
    a = F.abs("r")
    direction = F.when((F.col("cv") >= 0.5) & (a < 0.35), "volatile").when((a < 0.2) | (F.abs("slope") <= 1e-9), "flat").when(F.col("slope") > 0, "up").otherwise("down")
    strength = F.when(a >= 0.9, "very_strong").when(a >= 0.7, "strong").when(a >= 0.5, "moderate").when(a >= 0.3, "weak").otherwise("very_weak")
    return out.select("*", direction.alias("direction"), strength.alias("strength"))


def transitions(df: DataFrame, by: str, order: list, status: str, allowed: dict[str, list[str]]) -> DataFrame:
    """Rows whose status may not follow the last non-null one of their key; repeats and nulls are fine."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    table = F.create_map(*(v for k, to in allowed.items() for v in (F.lit(k), F.array(*map(F.lit, to)).cast("array<string>"))))
    out = df.withColumn("previous", F.last(status, ignorenulls=True).over(w)).where(F.col(status).isNotNull() & F.col("previous").isNotNull() & (F.col(status) != F.col("previous")))
    return out.where(~F.coalesce(F.array_contains(F.element_at(table, F.col("previous")), F.col(status)), F.lit(False)))


def series_shape(df: DataFrame, by: list[str], order: str, value: str, window: int, long_window: int, period: int) -> DataFrame:
    """by, n, momentum, acceleration, volatility, regime_change, seasonal_strength of each (pre-aggregated) series.

    momentum: the last value against the one ``window`` before, relative; acceleration: slope of
    the last ``window`` values less that of the ones before; volatility: |deviation / mean|;
    regime_change: mean of the last ``long_window`` values against that of the ones before,
    relative; seasonal_strength: deviation of the ``period`` places' means over the mean. Null
    where there are too few values or a mean is 0.
    """
    w = Window.partitionBy(*by)
    v = F.col(value).cast("double")
    x = df.where(v.isNotNull()).withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    back = F.col("_n") - F.col("_i")  # 1 for the last value
    at = lambda k: F.max(F.when(back == k, v))
    between = lambda c, lo, hi: F.when((back > lo) & (back <= hi), c)
    i = F.col("_i").cast("double")
    slope = lambda lo, hi: F.regr_slope(between(v, lo, hi), between(i, lo, hi))
    relative = lambda a, b: F.try_divide(a - b, F.abs(b))
    n = F.max("_n")
    out = x.groupBy(*by).agg(
        n.alias("n"), F.when(n > window, relative(at(1), at(window + 1))).alias("momentum"), F.when(n >= 2 * window, slope(0, window) - slope(window, 2 * window)).alias("acceleration"),
        F.abs(F.try_divide(F.stddev_samp(v), F.avg(v))).alias("volatility"), F.when(n >= 2 * long_window, relative(F.avg(between(v, 0, long_window)), F.avg(between(v, long_window, 2 * long_window)))).alias("regime_change"), F.avg(v).alias("_m"),
    )
    places = x.groupBy(*by, (F.col("_i") % period).alias("_p")).agg(F.avg(v).alias("_pm")).groupBy(*by).agg(F.stddev_samp("_pm").alias("_ps"))
    out = out.join(places, by)
    return out.withColumn("seasonal_strength", F.when(F.col("n") >= 2 * period, F.try_divide(F.col("_ps"), F.abs("_m")))).drop("_m", "_ps")
