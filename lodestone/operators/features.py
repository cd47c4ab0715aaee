"""Features of rows, entities and series as Columns and windows; each entity's window is one shuffle by its key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .timeseries import sessions


def calendar(ts: Column) -> dict[str, Column]:
    """Parts of a timestamp; day_of_week counts from Monday (0), week is the ISO week; the month also as a place on a circle."""
    turn = 2 * math.pi / 12
    return {
        "year": F.year(ts), "month": F.month(ts), "day": F.day(ts), "day_of_week": F.weekday(ts), "day_of_year": F.dayofyear(ts), "week": F.weekofyear(ts), "hour": F.hour(ts), "quarter": F.quarter(ts),
        "is_weekend": F.weekday(ts) >= 5, "is_month_start": F.day(ts) == 1, "is_month_end": F.last_day(ts) == F.to_date(ts), "month_sin": F.sin(F.month(ts) * turn), "month_cos": F.cos(F.month(ts) * turn),
    }


def one_hot(c: Column, values: list, prefix: str) -> dict[str, Column]:
    return {f"{prefix}_{v}": F.coalesce((c == v).cast("int"), F.lit(0)) for v in values}


def binned(c: Column, edges: list[float]) -> Column:
    """The number of edges at or below the value; null stays null."""
    return F.when(c.isNotNull(), sum(((c >= e).cast("int") for e in edges), F.lit(0)))


def first_text(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def frequency_encoded(df: DataFrame, category: str) -> DataFrame:
    """df with ``<category>_share``, the share of rows with its value among those that have one."""
    n = df.where(F.col(category).isNotNull()).groupBy(F.col(category).alias("_v")).agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_t"))
    shares = n.crossJoin(F.broadcast(total)).select("_v", (F.col("_n") / F.col("_t")).alias(f"{category}_share"))
    return df.join(shares, F.col(category) == F.col("_v"), "left").drop("_v")


def scaled_within(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``<value>_log`` (of values below 0 as 0) and ``<value>_z`` within the entity (sample deviation; null where it is 0)."""
    w, c = Window.partitionBy(*by), F.col(value)
    sd = F.stddev_samp(c).over(w)
    return df.withColumns({f"{value}_log": F.log1p(F.greatest(c, F.lit(0.0))), f"{value}_z": F.when(sd > 0, (c - F.avg(c).over(w)) / sd)})


def group_share(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Sum and number of the rows that share the group, and the row's part of the sum, beside each row."""
    w = Window.partitionBy(*by)
    return df.withColumns({"group_sum": F.sum(value).over(w), "group_n": F.count("*").over(w), "group_share": F.try_divide(F.col(value), F.sum(value).over(w))})


def supervised(df: DataFrame, by: list[str], order: list[str], value: str, horizon: int) -> DataFrame:
    """df with ``target``, the value ``horizon`` rows ahead; rows without one are left out."""
    return df.withColumn("target", F.lead(value, horizon).over(Window.partitionBy(*by).orderBy(*order))).where(F.col("target").isNotNull())


def one_for_each_time(df: DataFrame, by: list[str], time: Column, tie: str, value: str, keep: str = "last") -> DataFrame:
    """by, time, value, n: rows of one entity with one time become one, by keeping the first or last (by ``tie``) or the mean."""
    f = {"first": F.min_by(value, tie), "last": F.max_by(value, tie), "mean": F.avg(value)}[keep]
    return df.groupBy(*by, time.alias("time")).agg(f.alias(value), F.count("*").alias("n"))


def inferred_step(df: DataFrame, by: list[str], ts: str) -> DataFrame:
    """by, step_seconds: the most frequent step between different times of an entity with three times or more (of equally frequent ones the shortest)."""
    times = df.select(*by, F.unix_timestamp(F.col(ts).cast("timestamp")).alias("t")).distinct()
    w = Window.partitionBy(*by).orderBy("t")
    steps = times.select(*by, (F.col("t") - F.lag("t").over(w)).alias("step"), F.count("*").over(Window.partitionBy(*by)).alias("_n")).where("step is not null and _n >= 3")
    n = steps.groupBy(*by, "step").agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg((-F.max(F.struct("n", (-F.col("step")).alias("s")))["s"]).alias("step_seconds"))


def backward_steps(df: DataFrame, by: list[str], order: str, ts: str) -> DataFrame:
    """by, n, backward: how often an entity's time runs backward in the rows' order."""
    back = F.col(ts) < F.lag(ts).over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("_b", back).groupBy(*by).agg(F.count("*").alias("n"), F.count_if("_b").alias("backward"))


def new_values(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """df with ``is_new``: the entity has a history, and this value is not in it."""
    seen = F.row_number().over(Window.partitionBy(by, value).orderBy(*order))
    at = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("is_new", F.col(value).isNotNull() & (seen == 1) & (at > 1))


def running_stats(df: DataFrame, by: str, order: list[str], value: str, kept: int = 500) -> DataFrame:
    """df with number, mean, sample and population deviation of the entity's values before the row, median and 95th percentile of the last ``kept`` of them, and the value before (0 for none)."""
    w = Window.partitionBy(by).orderBy(*order)
    past, few = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(-kept, -1)
    sd = F.stddev_pop(value).over(past)
    return df.withColumns({
        "past_n": F.count(value).over(past), "past_mean": F.avg(value).over(past), "past_sd": F.stddev_samp(value).over(past), "past_spread": F.coalesce(sd, F.lit(0.0)),
        "past_median": F.percentile(value, F.lit(0.5)).over(few), "past_p95": F.percentile(value, F.lit(0.95)).over(few), "past_last": F.coalesce(F.lag(value).over(w), F.lit(0.0)),
    })


#: An engagement score's points for each event, session, purchase and use of a feature, the days that recency counts, and the levels.
ENGAGEMENT = {"event": 1.0, "session": 5.0, "purchase": 20.0, "feature_used": 3.0, "days": 30.0}
LEVELS = ((150.0, "power_user"), (75.0, "high"), (25.0, "medium"))


def engagement(df: DataFrame, by: str, ts: str, tie: str, kind: str, as_of: Column, gap_seconds: int = 1800, purchase: str = "purchase", feature: str = "feature_used") -> DataFrame:
    """by, events, sessions, score, level: points for events, sessions (parted by more than the gap), purchases and uses of features, and up to 30 for being here lately (whole days before ``as_of``)."""
    p = ENGAGEMENT
    own = sessions(df.where(F.col(ts).isNotNull()), by, ts, gap_seconds, [tie]).groupBy(by).agg(F.count("*").alias("events"), F.max("session").alias("sessions"), F.count_if(F.col(kind) == purchase).alias("_p"), F.count_if(F.col(kind) == feature).alias("_f"), F.max(ts).alias("_latest"), F.max(as_of).alias("_now"))
    days = F.floor((F.unix_micros(F.col("_now").cast("timestamp")) - F.unix_micros(F.col("_latest").cast("timestamp"))) / 86_400_000_000)
    score = F.col("events") * p["event"] + F.col("sessions") * p["session"] + F.col("_p") * p["purchase"] + F.col("_f") * p["feature_used"] + F.greatest(F.lit(0.0), p["days"] - F.greatest(F.lit(0), days))
    level = F.lit("low")
    for least, name in reversed(LEVELS):
        level = F.when(F.col("score") >= least, name).otherwise(level)
    return own.withColumn("score", score).select(by, "events", F.col("sessions").cast("long").alias("sessions"), "score", level.alias("level"))


def repeated_amounts(df: DataFrame, keys: list[str], key: str, amount: str, ts: str, seconds: int) -> DataFrame:
    """The rows' ``key`` for which an earlier row (by time, then key) of the same keys has the same amount to 0.01 within the time.

    Only existence is asked, so rows do not meet in pairs: each one looks back, among the
    rows of its cents and of both neighbours in its span of time and the one before, at the
    latest of each. Where the latest of a neighbour is in time but differs by more than
    0.01 (amounts between the cents), earlier ones may not: those few rows are joined.
    """
    cents, at = F.round(F.col(amount) * 100).cast("long"), F.unix_micros(F.col(ts).cast("timestamp"))
    wait = seconds * 1_000_000
    rows = df.select(*keys, F.col(key), F.col(amount).alias("_a"), at.alias("_t"), cents.alias("_c")).where("_a IS NOT NULL AND _t IS NOT NULL")
    rows = rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)) if keys else rows
    rows = rows.withColumn("_s", F.floor(F.col("_t") / max(1, wait)).cast("long"))
    # a row stands in its own cents and, as a neighbour, in those beside it; in its own span of time and, as one before, in the next
    places = F.array(*(F.struct((F.col("_c") + d).alias("_c"), (F.col("_s") + s).alias("_s"), F.lit(d).alias("_d"), F.lit(s == 0 and d == 0).alias("_asks")) for d in (-1, 0, 1) for s in (0, 1)))
    placed = rows.select(*keys, key, "_a", "_t", F.explode(places).alias("_p")).select(*keys, key, "_a", "_t", "_p.*")
    w = Window.partitionBy(*keys, "_c", "_s").orderBy("_t", key).rowsBetween(Window.unboundedPreceding, -1)
    latest = {f"_l{d + 1}": F.last(F.when(F.col("_d") == d, F.struct("_t", "_a")), ignorenulls=True).over(w) for d in (-1, 0, 1)}
    seen = placed.withColumns(latest).where("_asks")
    timely = [F.coalesce(F.col("_t") - F.col(f"_l{i}._t") <= wait, F.lit(False)) for i in range(3)]
    equal = [F.abs(F.col("_a") - F.col(f"_l{i}._a")) <= 0.01 + 1e-9 for i in range(3)]
    hit = (timely[0] & equal[0]) | (timely[1] & equal[1]) | (timely[2] & equal[2])
    seen = cut(seen.select(*keys, key, "_a", "_t", "_c", hit.alias("_hit"), (timely[0] | timely[1] | timely[2]).alias("_open")), "amounts")
    late = seen.where("_open AND NOT _hit").select(*keys, F.col(key), "_a", "_t", F.explode(F.array(F.col("_c") - 1, F.col("_c"), F.col("_c") + 1)).alias("_c"))
    early = rows.select(*keys, F.col(key).alias("_k"), F.col("_a").alias("_b"), F.col("_t").alias("_u"), "_c")
    d = F.col("_t") - F.col("_u")
    earlier = (d > 0) | ((d == 0) & (F.col("_k") < F.col(key)))
    rest = late.join(early, [*keys, "_c"]).where(earlier & (d <= wait) & (F.abs(F.col("_a") - F.col("_b")) <= 0.01 + 1e-9)).select(key)
    return seen.where("_hit").select(key).union(rest).distinct()


def quick_changes(df: DataFrame, by: str, order: list[str], place: str, ts: str, seconds: int) -> DataFrame:
    """df with ``is_jump``: the place differs from the entity's one before, at most so many seconds ago."""
    w = Window.partitionBy(by).orderBy(*order)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(w)
    return df.withColumn("is_jump", F.coalesce((F.col(place) != F.lag(place).over(w)) & (gap <= seconds * 1_000_000), F.lit(False)))


def windows_as_of(df: DataFrame, by: list[str], ts: str, value: str, as_of: Column, hours: dict[str, int]) -> DataFrame:
    """by and, for each named trailing window that ends at ``as_of``, count, sum, mean and last value: conditional aggregates over one scan."""
    t = F.col(ts).cast("timestamp")
    aggs = []
    for name, h in hours.items():
        v = F.when((t <= as_of) & (t > as_of - F.make_dt_interval(F.lit(0), F.lit(h))), F.col(value))
        aggs += [F.count(v).alias(f"n_{name}"), F.sum(v).alias(f"sum_{name}"), F.avg(v).alias(f"mean_{name}"), F.max_by(v, F.when(v.isNotNull(), t)).alias(f"last_{name}")]
    return df.groupBy(*by).agg(*aggs)


def distances(df: DataFrame, values: list[str], least: float = 1e-9) -> DataFrame:
    """df with ``distance``: the Euclidean length of the row's z-scores over the columns (sample deviation; null counts as the mean)."""
    stats = df.agg(*(f.alias(n) for v in values for n, f in ((f"_m_{v}", F.avg(v)), (f"_d_{v}", F.stddev_samp(v)))))
    z = [F.coalesce((F.col(v) - F.col(f"_m_{v}")) / F.greatest(F.col(f"_d_{v}"), F.lit(least)), F.lit(0.0)) for v in values]
    return df.crossJoin(F.broadcast(stats)).withColumn("distance", F.sqrt(sum((x * x for x in z), F.lit(0.0)))).select(*df.columns, "distance")


def broken_links(df: DataFrame, by: list[str], order: list[str], own: str, previous: str, digest: Column) -> DataFrame:
    """df with ``tampered`` (the stored hash is not the row's) and ``unlinked`` (the stored previous hash is not that of the row before)."""
    before = F.lag(own).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumns({"tampered": ~F.col(own).eqNullSafe(digest), "unlinked": ~F.col(previous).eqNullSafe(before)})
