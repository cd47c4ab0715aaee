"""Forecasts from lags: one model over all series of a table, steps that feed on steps before, expanding-window backtests and scenarios.

Training rows are window functions over the series; the model is an ensemble of Spark
ML trees, or the mean of the last values. A forecast keeps for each series an array of
its last values: every step makes the features of all series from it in one projection,
predicts, and appends.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


@dataclass(frozen=True)
class Lags:
    """The features of a period: the values ``lags`` periods before, mean and population deviation of the last ``windows`` values, and the place in a season."""

    lags: tuple[int, ...] = (1, 2, 3, 7)
    windows: tuple[int, ...] = (7,)
    season: int = 0

    @property
    def depth(self) -> int:
        return max((*self.lags, *self.windows))

    @property
    def names(self) -> list[str]:
        return [f"lag_{k}" for k in self.lags] + [f"{f}_{w}" for w in self.windows for f in ("mean", "sd")] + (["place"] if self.season else [])


def indexed(df: DataFrame, by: list[str], period: str, value: str) -> DataFrame:
    """by, t (0, 1, ... in the order of periods), value; null values count 0. Periods should be filled before."""
    t = F.row_number().over(Window.partitionBy(*by).orderBy(period)) - 1
    return df.where(F.col(period).isNotNull()).select(*by, t.alias("t"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("value"))


def training_rows(rows: DataFrame, by: list[str], spec: Lags) -> DataFrame:
    """rows (by, t, value) with the features of each period that has ``spec.depth`` periods before it."""
    w = Window.partitionBy(*by).orderBy("t")
    out = {f"lag_{k}": F.lag("value", k).over(w) for k in spec.lags}
    for k in spec.windows:
        few = w.rowsBetween(-k, -1)
        out |= {f"mean_{k}": F.avg("value").over(few), f"sd_{k}": F.stddev_pop("value").over(few)}
    if spec.season:
        out["place"] = F.pmod(F.col("t"), F.lit(spec.season)).cast("double")
    return rows.withColumns(out).where(F.col("t") >= spec.depth)


def features_of(xs: Column, t: Column, spec: Lags) -> dict[str, Column]:
    """The same features from the array of a series' last values, for period t."""
    out = {f"lag_{k}": F.element_at(xs, -k) for k in spec.lags}
    for k in spec.windows:
        few = F.slice(xs, -k, k)
        mean = F.aggregate(few, F.lit(0.0), lambda a, x: a + x) / k
        out[f"mean_{k}"] = mean
        out[f"sd_{k}"] = F.sqrt(F.aggregate(few, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / k)
    if spec.season:
        out["place"] = F.pmod(t, F.lit(spec.season)).cast("double")
    return out


#: A fitted model: takes rows with the features, gives them with ``predicted``.
Model = Callable[[DataFrame], DataFrame]


def moving_average(window: int = 7) -> Callable[[DataFrame, Lags], Model]:
    """Needs ``window`` among the windows; learns nothing."""
    return lambda rows, spec: lambda df: df.withColumn("predicted", F.col(f"mean_{window}"))


def trees(kind: str = "forest", count: int = 40, depth: int = 5, seed: int = 42) -> Callable[[DataFrame, Lags], Model]:
    """A random forest or boosted trees over all series, by Spark ML; all rows are read, in its own distributed passes."""

    def fit(rows: DataFrame, spec: Lags) -> Model:
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

        assembler = VectorAssembler(inputCols=spec.names, outputCol="_x")
        common = dict(featuresCol="_x", labelCol="value", predictionCol="predicted", maxDepth=depth, seed=seed)
        ensemble = RandomForestRegressor(numTrees=count, **common) if kind == "forest" else GBTRegressor(maxIter=count, **common)
        model = ensemble.fit(assembler.transform(rows.select(*spec.names, "value")))
        return lambda df: model.transform(assembler.transform(df)).drop("_x")

    return fit


def forecast(rows: DataFrame, by: list[str], model: Model, spec: Lags, steps: int) -> DataFrame:
    """by, step (1, 2, ...), t, predicted: what follows each series of rows (by, t, value). Series with fewer than ``spec.depth`` periods are left out."""
    size = Window.partitionBy(*by)
    last = rows.withColumn("_n", F.max("t").over(size)).where(F.col("t") > F.col("_n") - spec.depth)
    state = last.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda x: x["value"]).alias("_xs"), F.max("t").alias("t")).where(F.size("_xs") == spec.depth)
    out = None
    for step in range(1, steps + 1):
        state = state.withColumn("t", F.col("t") + 1)
        state = model(state.withColumns(features_of(F.col("_xs"), F.col("t"), spec))).drop(*spec.names)
        state = cut(state.withColumn("_xs", F.concat(F.slice("_xs", 2, spec.depth - 1), F.array("predicted"))), "steps")
        one = state.select(*by, F.lit(step).alias("step"), "t", "predicted")
        out = one if out is None else out.unionByName(one)
        state = state.drop("predicted")
    return out


def folds(n: int, count: int, spec: Lags) -> list[tuple[int, int]]:
    """(end of training, end of test) of expanding windows over n periods: the first window has ten periods more than the features reach back (30 at least), the rest is dealt evenly."""
    first = max(spec.depth + 10, 30)
    step = max((n - first) // max(count, 1), 1)
    return [(a, min(a + step, n)) for a in range(first, first + count * step, step) if a < n]


def backtest(rows: DataFrame, by: list[str], fit: Callable[[DataFrame, Lags], Model], spec: Lags, windows: list[tuple[int, int]]) -> DataFrame:
    """fold (from 1), train_end, n, mae, rmse, mape (of actual values other than 0), bias: each fold's model knows the periods before ``train_end`` only and forecasts the next ones step by step."""
    rows, out = cut(rows, "series"), None
    for k, (end, stop) in enumerate(windows, 1):
        past = rows.where(F.col("t") < end)
        model = fit(training_rows(past, by, spec), spec)
        ahead = forecast(past, by, model, spec, stop - end).select(*by, "t", "predicted")
        actual = rows.where((F.col("t") >= end) & (F.col("t") < stop))
        error = F.col("predicted") - F.col("value")
        one = actual.join(ahead, [*by, "t"]).agg(F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.when(F.col("value") != 0, F.abs(error / F.col("value")))).alias("mape"), F.avg(error).alias("bias"))
        one = one.select(F.lit(k).alias("fold"), F.lit(end).alias("train_end"), "n", "mae", "rmse", "mape", "bias")
        out = one if out is None else out.unionByName(one)
    return out


#: What scenarios make of the better and the worse side.
LESS, MORE = 0.85, 1.15


def scenarios(inflow: DataFrame, outflow: DataFrame, by: list[str], deviation: float = 0.0, z: float = 1.96) -> DataFrame:
    """by, step, scenario, inflow, outflow, net, low, high: base, pessimistic (less comes in, more goes out) and optimistic; bounds are those of the base, ``z`` deviations off."""
    both = inflow.select(*by, "step", F.col("predicted").alias("_i")).join(outflow.select(*by, "step", F.col("predicted").alias("_o")), [*by, "step"])
    kinds = F.array(*(F.struct(F.lit(n).alias("scenario"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, a, b in (("base", 1.0, 1.0), ("pessimistic", LESS, MORE), ("optimistic", MORE, LESS))))
    rows = both.select(*by, "step", "_i", "_o", F.explode(kinds).alias("k"))
    base = F.col("_i") - F.col("_o")
    i, o = F.col("_i") * F.col("k.a"), F.col("_o") * F.col("k.b")
    return rows.select(*by, "step", "k.scenario", i.alias("inflow"), o.alias("outflow"), (i - o).alias("net"), (base - z * deviation).alias("low"), (base + z * deviation).alias("high"))
