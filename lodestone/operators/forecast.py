"""Forecasts of series that were aggregated to periods before, and finance formulas.

A series is one array for each entity, as long as its number of periods; the
models fold over it inside Spark's expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def series(df: DataFrame, by: list[str], period: Column, value: Column) -> DataFrame:
    """One row per entity with ``xs``, the sums of value in the order of the periods that occur."""
    sums = df.groupBy(*by, period.alias("_p")).agg(F.sum(value).alias("_v"))
    return sums.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_p", "_v"))).alias("xs")).select(*by, F.col("xs._v").alias("xs"))


def _recursive(xs: Column, steps: int, weights: list[float]) -> Column:
    """Each step is the weighted mean of the last values, forecasts included."""
    w = F.array(*(F.lit(float(x)) for x in weights))
    k = len(weights)

    def step(acc, _):
        last = F.slice(acc, F.greatest(F.lit(1), F.size(acc) - k + 1), F.lit(k))
        ws = F.slice(w, F.greatest(F.lit(1), k - F.size(last) + 1), F.lit(k))
        add = lambda a, b: a + b
        return F.concat(acc, F.array(F.aggregate(F.zip_with(last, ws, lambda a, b: a * b), F.lit(0.0), add) / F.aggregate(ws, F.lit(0.0), add)))

    return F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), xs, step), -steps, steps)


def forecast(df: DataFrame, by: list[str], model: str, steps: int, season: int = 12, window: int = 3, alpha: float = 0.3) -> DataFrame:
    """The entity, step (1, 2, ...) and value. Models: naive, seasonal, moving, weighted, smoothed, trend. A seasonal forecast of a series shorter than a season is naive."""
    xs, n = F.col("xs"), F.size("xs")
    at = F.sequence(F.lit(1), F.lit(steps))
    last = F.element_at(xs, -1)
    if model == "naive":
        out = F.transform(at, lambda h: last)
    elif model == "seasonal":
        out = F.transform(at, lambda h: F.when(n >= season, F.element_at(xs, (n - season + 1 + F.pmod(h - 1, F.lit(season))).cast("int"))).otherwise(last))
    elif model == "moving":
        out = _recursive(xs, steps, [1.0] * window)
    elif model == "weighted":
        out = _recursive(xs, steps, [float(i) for i in range(1, window + 1)])
    elif model == "smoothed":
        level = F.aggregate(F.slice(xs, 2, F.greatest(F.lit(0), n - 1)), F.element_at(xs, 1), lambda a, x: a + alpha * (x - a))
        out = F.transform(at, lambda h: level)
    elif model == "trend":
        mean_x, mean_y = (n - 1) / F.lit(2.0), F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / n
        cov = F.aggregate(F.transform(xs, lambda x, i: (i - mean_x) * (x - mean_y)), F.lit(0.0), lambda a, x: a + x)
        var = F.aggregate(F.transform(xs, lambda x, i: (i - mean_x) * (i - mean_x)), F.lit(0.0), lambda a, x: a + x)
        slope = F.coalesce(cov / F.nullif(var, F.lit(0.0)), F.lit(0.0))
        out = F.transform(at, lambda h: mean_y + slope * (n - 1 + h - mean_x))
    else:
        raise ValueError(f"unknown model {model}")
    return df.where(n > 0).select(*by, F.posexplode(out).alias("step", "value")).withColumn("step", F.col("step") + 1)


def payment(principal: Column, rate: float, n: int) -> Column:
    """The constant payment of a loan."""
    return principal / n if rate == 0 else principal * (rate * (1 + rate) ** n / ((1 + rate) ** n - 1))


def schedule(df: DataFrame, key: str, principal: str, rate: float, n: int) -> DataFrame:
    """key, period, interest, repaid and balance of each payment, in closed form; the last balance is 0."""
    p, pay = F.col(principal), payment(F.col(principal), rate, n)

    def balance(k):
        return p * (1 - k / F.lit(float(n))) if rate == 0 else p * F.pow(F.lit(1 + rate), k) - pay * (F.pow(F.lit(1 + rate), k) - 1) / rate

    rows = df.select(key, principal, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("period"))
    k = F.col("period")
    end = F.when(k == n, 0.0).otherwise(balance(k))
    return rows.select(key, "period", (balance(k - 1) * rate).alias("interest"), (balance(k - 1) - end).alias("repaid"), end.alias("balance"))


def net_present_value(df: DataFrame, by: list[str], period: Column, flow: Column, rate: float) -> DataFrame:
    """The sum of flows discounted by their period (0, 1, ...): one aggregation, combined before its shuffle."""
    return df.groupBy(*by).agg(F.sum(flow / F.pow(F.lit(1.0 + rate), period)).alias("npv"))
