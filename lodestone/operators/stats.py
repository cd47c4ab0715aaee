"""Descriptive statistics, association, drift and model evaluation."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .ranges import average_ranks, beside, quantiles


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, mean, sd (sample), cv, skew and kurtosis (moments over the sample deviation), min, q1, median, q3, max."""
    c = F.col(value).cast("double")
    out = df.groupBy(*by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.skewness(c).alias("_s"), F.kurtosis(c).alias("_k"), F.stddev_pop(c).alias("_p"), F.min(c).alias("min"), F.max(c).alias("max"))
    out = beside(out, quantiles(df, by, c, {"q1": 0.25, "median": 0.5, "q3": 0.75}), by)
    ratio = F.try_divide(F.col("_p"), F.col("sd"))
    return out.select(*by, "n", "mean", "sd", F.try_divide(F.col("sd"), F.abs("mean")).alias("cv"), (F.col("_s") * F.pow(ratio, 3)).alias("skew"), ((F.col("_k") + 3) * F.pow(ratio, 4) - 3).alias("kurtosis"), "min", "q1", "median", "q3", "max")


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r of the rows that have both values, as an aggregate; 0 where either does not vary."""
    x, y = a.cast("double"), b.cast("double")
    spread = F.sqrt(F.var_pop(F.when(y.isNotNull(), x)) * F.var_pop(F.when(x.isNotNull(), y)))
    return F.coalesce(F.try_divide(F.covar_pop(x, y), spread), F.lit(0.0))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r for each pair of columns, from one scan; 0 where undefined."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*(correlation(F.col(a), F.col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    return row.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)))))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, rho: the correlation of average ranks within groups."""
    for c in (x, y):
        df = average_ranks(df, by, c, f"_{c}")
    return df.groupBy(*by).agg(correlation(F.col(f"_{x}"), F.col(f"_{y}")).alias("rho"))


def regression(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    a, b = F.col(y).cast("double"), F.col(x).cast("double")
    return df.groupBy(*by).agg(F.regr_count(a, b).alias("n"), F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"), F.regr_r2(a, b).alias("r2"))


def total_variation(base: DataFrame, now: DataFrame, field: str) -> DataFrame:
    """distance (half the sum of share differences), unseen (categories that only ``now`` has)."""
    def shares(df, name):
        n = df.groupBy(F.col(field).alias("v")).agg(F.count("*").alias("n"))
        return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).select("v", (F.col("n") / F.col("t")).alias(name))

    p = shares(base, "p").withColumnRenamed("v", "pv")
    both = p.join(shares(now, "q"), F.col("pv").eqNullSafe(F.col("v")), "full")
    return both.agg((F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2).alias("distance"), F.count_if(F.col("p").isNull()).alias("unseen"))


def psi(base: DataFrame, now: DataFrame, value: str, bins: int = 10, eps: float = 1e-8) -> DataFrame:
    """The population stability index over the base's quantile bins."""
    edges = quantiles(base, [], F.col(value), {f"q{i}": i / bins for i in range(1, bins)})
    cuts = cut(edges.select(F.array_distinct(F.array_compact(F.array(*(f"q{i}" for i in range(1, bins))))).alias("cuts")), "cuts")

    def shares(df, name):
        b = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(cuts)).groupBy(F.size(F.filter("cuts", lambda c: c < F.col(value))).alias("bin")).agg(F.count("*").alias("n"))
        return b.crossJoin(F.broadcast(b.agg(F.sum("n").alias("t")))).select("bin", (F.col("n") / F.col("t")).alias(name))

    both = shares(base, "p").join(shares(now, "q"), "bin", "full")
    p, q = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(eps)) for c in "pq")
    return both.agg(F.sum((q - p) * F.log(q / p)).alias("psi"), F.count("*").alias("bins"))


def ks(base: DataFrame, now: DataFrame, value: str, buckets: int = 256) -> DataFrame:
    """The largest distance of the two distribution functions.

    Values are counted first; running sums are taken inside ranges of the values
    and the ranges' totals are added, so no task sees all values.
    """
    side = lambda df, a, b: df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    n = cut(side(base, 1, 0).union(side(now, 0, 1)).groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "values")
    cuts = n.agg(F.array_distinct(F.percentile_approx("v", F.array(*(F.lit(i / buckets) for i in range(1, buckets))))).alias("cuts"))
    n = n.crossJoin(F.broadcast(cuts)).select("v", "a", "b", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("range"))
    run = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    start = n.groupBy("range").agg(F.sum("a").alias("ra"), F.sum("b").alias("rb")).select("range", *(F.coalesce(F.sum(c).over(run), F.lit(0)).alias(f"{c}0") for c in ("ra", "rb")))
    inside = Window.partitionBy("range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    t = n.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    d = n.select("range", F.sum("a").over(inside).alias("ca"), F.sum("b").over(inside).alias("cb")).join(F.broadcast(start), "range").crossJoin(F.broadcast(t))
    return d.agg(F.max(F.abs((F.col("ca") + F.col("ra0")) / F.col("ta") - (F.col("cb") + F.col("rb0")) / F.col("tb"))).alias("ks"))


def classification(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """n, accuracy, precision, recall, f1 of 0/1 columns; undefined ratios are 0."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    c = df.agg(F.count("*").alias("n"), F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    z = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("n", z(tp + tn, F.col("n")).alias("accuracy"), z(tp, tp + fp).alias("precision"), z(tp, tp + fn).alias("recall"), z(2 * tp, 2 * tp + fp + fn).alias("f1"))


def forecast_errors(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    e, a, p = F.col(actual) - F.col(predicted), F.col(actual), F.col(predicted)
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.when(a != 0, F.abs(e / a))).alias("mape"), F.avg(F.try_divide(2 * F.abs(e), F.abs(a) + F.abs(p))).alias("smape"), F.avg(-e).alias("bias"))


def scaled(df: DataFrame, columns: list[str], method: str = "standard") -> DataFrame:
    """Columns scaled by whole-table statistics (population deviation; 0 counts as 1)."""
    stats = []
    for c in columns:
        a, b = {"standard": (F.avg(c), F.stddev_pop(c)), "minmax": (F.min(c), F.max(c) - F.min(c)), "robust": (F.percentile(c, F.lit(0.5)), F.percentile(c, F.lit(0.75)) - F.percentile(c, F.lit(0.25)))}[method]
        stats += [a.alias(f"_a_{c}"), b.alias(f"_b_{c}")]
    joined = df.crossJoin(F.broadcast(df.agg(*stats)))
    return joined.withColumns({c: (F.col(c) - F.col(f"_a_{c}")) / F.when(F.col(f"_b_{c}") == 0, 1.0).otherwise(F.col(f"_b_{c}")) for c in columns}).select(*df.columns)


def target_encoded(df: DataFrame, category: str, target: str) -> DataFrame:
    """df with ``<category>_encoded``: the category's mean of the target (null target left out; the whole mean for a category without one)."""
    means = df.groupBy(F.col(category).alias("_c")).agg(F.avg(target).alias("_m"))
    whole = df.agg(F.avg(target).alias("_all"))
    return df.join(means, F.col(category).eqNullSafe(F.col("_c")), "left").crossJoin(F.broadcast(whole)).withColumn(f"{category}_encoded", F.coalesce("_m", "_all")).drop("_c", "_m", "_all")


def confidence_intervals(df: DataFrame, by: list[str], value: str, level: float = 0.95) -> DataFrame:
    """by, n, mean, standard_error, lower, upper of the mean's normal confidence interval; groups of fewer than two values are left out."""
    z = NormalDist().inv_cdf(0.5 + level / 2)
    c = F.col(value).cast("double")
    out = df.groupBy(*by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), (F.stddev_samp(c) / F.sqrt(F.count(c))).alias("standard_error")).where("n > 1")
    return out.select("*", (F.col("mean") - z * F.col("standard_error")).alias("lower"), (F.col("mean") + z * F.col("standard_error")).alias("upper"))


def _decided(df: DataFrame, alpha: float, alternative: str) -> DataFrame:
    """df with ``reject``: whether the statistic lies beyond the normal critical value (its approximate p-value is below alpha)."""
    z = F.col("statistic")
    at = NormalDist().inv_cdf(1 - (alpha / 2 if alternative == "two_sided" else alpha))
    return df.withColumn("reject", {"two_sided": F.abs(z) > at, "greater": z > at, "less": z < -at}[alternative])


def one_sample_test(df: DataFrame, by: list[str], value: str, null_value: float, alpha: float = 0.05, alternative: str = "two_sided") -> DataFrame:
    """by, statistic, reject of the mean against null_value; groups without spread have neither."""
    c = F.col(value).cast("double")
    return _decided(df.groupBy(*by).agg(F.try_divide(F.avg(c) - null_value, F.stddev_samp(c) / F.sqrt(F.count(c))).alias("statistic")), alpha, alternative)


def two_sample_test(df: DataFrame, by: list[str], value: str, first, null_value: float = 0.0, alpha: float = 0.05, alternative: str = "two_sided") -> DataFrame:
    """by, statistic, reject of the difference of means between the rows where ``first`` holds and the others; one scan."""
    a, b = F.when(first, F.col(value).cast("double")), F.when(~first, F.col(value).cast("double"))
    error = F.sqrt(F.var_samp(a) / F.count(a) + F.var_samp(b) / F.count(b))
    return _decided(df.groupBy(*by).agg(F.try_divide(F.avg(a) - F.avg(b) - null_value, error).alias("statistic")), alpha, alternative)


def proportion_test(df: DataFrame, by: list[str], success, null_value: float, alpha: float = 0.05, alternative: str = "two_sided") -> DataFrame:
    """by, share, statistic, reject of the share of rows where ``success`` holds against null_value."""
    share = F.count_if(success) / F.count("*")
    error = F.sqrt(F.lit(null_value * (1 - null_value)) / F.count("*"))
    return _decided(df.groupBy(*by).agg(share.alias("share"), F.try_divide(share - null_value, error).alias("statistic")), alpha, alternative)
