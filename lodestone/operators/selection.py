"""Feature selection: which columns of a table are worth keeping for a target, and why the others are not.

A few scans: each of the first holds some moments and co-moments of the numeric columns; one
grouping of unpivoted (feature, value, class) cells holds the distinct values of all
columns and the contingency tables of the categorical ones. What follows has a row for
each column (or pair of columns), whatever the size of the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .stats import correlation

#: Against division by 0.
EPSILON = 1e-12
#: Correlations of one scan.
TOGETHER = 7


def _missing(c: Column) -> Column:
    return c.isNull() | (c.cast("string") == "")


def cells(df: DataFrame, numeric: list[str], categorical: list[str], target: str | None) -> DataFrame:
    """feature, value (text, null if missing), class (of categorical features only), n: the cells of all columns' tables in one grouping."""
    klass = F.when(~_missing(F.col(target)), F.col(target).cast("string")) if target else F.lit(None).cast("string")
    each = [F.struct(F.lit(c).alias("feature"), F.when(~_missing(F.col(c)), F.col(c).cast("string")).alias("value"), (klass if c in categorical else F.lit(None).cast("string")).alias("class")) for c in [*numeric, *categorical]]
    return df.select(F.inline(F.array(*each))).groupBy("feature", "value", "class").agg(F.count("*").alias("n"))


def profiles(cell: DataFrame) -> DataFrame:
    """feature, n, missing_ratio, distinct_count, distinct_ratio."""
    values = cell.groupBy("feature", "value").agg(F.sum("n").alias("n"))
    missing = F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0))
    out = values.groupBy("feature").agg(F.sum("n").alias("n"), missing.alias("missing"), F.count("value").alias("distinct_count"))
    return out.select("feature", "n", F.round(F.col("missing") / F.col("n"), 6).alias("missing_ratio"), "distinct_count", F.round(F.col("distinct_count") / F.col("n"), 6).alias("distinct_ratio"))


def chi_association(cell: DataFrame) -> DataFrame:
    """feature, association: chi-square over the observed cells and the number of rows, at most 1."""
    joint = cell.where(F.col("value").isNotNull() & F.col("class").isNotNull())
    of_value = joint.groupBy("feature", "value").agg(F.sum("n").alias("nv"))
    of_class = joint.groupBy("feature", "class").agg(F.sum("n").alias("nc"))
    total = of_class.groupBy("feature").agg(F.sum("nc").alias("t"))
    expected = F.col("nv") * F.col("nc") / F.col("t")
    d = F.col("n") - expected
    each = joint.join(of_value, ["feature", "value"]).join(of_class, ["feature", "class"]).join(total, "feature")
    return each.groupBy("feature").agg(F.least(F.lit(1.0), F.sum(d * d / F.greatest(expected, F.lit(EPSILON))) / F.max("t")).alias("association"))


def group_separation(df: DataFrame, numeric: list[str], target: str) -> DataFrame:
    """feature, association: eta squared, the variation of a numeric column between the target's classes and in all (0 with fewer than two classes)."""
    rows = df.where(~_missing(F.col(target)))
    moments = [a for c in numeric for a in (F.count(c).alias(f"n_{c}"), F.avg(c).alias(f"m_{c}"), F.var_pop(c).alias(f"v_{c}"))]
    groups = rows.groupBy(target).agg(*moments)
    each = groups.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"n_{c}").alias("n"), F.col(f"m_{c}").cast("double").alias("m"), F.col(f"v_{c}").alias("v")) for c in numeric)))).where("n > 0")
    whole = each.groupBy("feature").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.count("*").alias("classes"))
    d = F.col("m") - F.col("mean")
    between, within = F.sum(F.col("n") * d * d), F.sum(F.col("n") * F.col("v"))
    out = each.join(whole, "feature").groupBy("feature").agg(F.max("classes").alias("classes"), (between / F.greatest(between + within, F.lit(EPSILON))).alias("x"))
    return out.select("feature", F.when(F.col("classes") > 1, F.col("x")).otherwise(0.0).alias("association"))


def co_moments(df: DataFrame, numeric: list[str], target: str | None) -> DataFrame:
    """One row: variances (v0, v1, ...), correlations with a numeric target (t0, ...) and with one another (c0_1, ...), over the rows that have both."""
    names = sorted(numeric)
    r = lambda a, b: correlation(F.col(a), F.col(b))
    out = [F.var_pop(F.col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(names)]
    out += [r(c, target).alias(f"t{i}") for i, c in enumerate(names) if target]
    out += [r(a, b).alias(f"c{i}_{i + 1 + j}") for i, a in enumerate(names) for j, b in enumerate(names[i + 1 :])]
    # an aggregate of many buffers is not compiled and takes several times as long as a few scans
    parts = [df.agg(*out[i : i + TOGETHER]) for i in range(0, len(out), TOGETHER)] or [df.agg(F.count("*").alias("n"))]
    return reduce(DataFrame.crossJoin, parts)


def select_features(
    df: DataFrame, numeric: list[str], categorical: list[str], target: str | None = None, numeric_target: bool = False, required: tuple[str, ...] = (), max_missing: float = 0.95, min_variance: float = 0.0,
    max_cardinality: float = 1.0, min_distinct: int = 1, max_correlation: float = 0.95, min_target: float = 0.0, max_features: int | None = None,
) -> DataFrame:
    """feature, status (required, selected, rejected), rank, score, target_score, penalty, reasons: one row for each column.

    A column is rejected for too many missing values, too few or (by share) too many
    distinct ones, too little variance, too little association with the target, a
    correlation of ``max_correlation`` or more with a column of at least its score, and
    for being behind the first ``max_features``. Required columns stay in any case. The
    association is a correlation (numeric target), eta squared (numeric column, target
    of classes), or chi-square by rows; a categorical column has none with a numeric
    target. Empty texts count as missing. Correlations are over rows that have both values.
    """
    names = sorted(numeric)
    cell = cut(cells(df, numeric, categorical, None if numeric_target else target), "cells")
    profile = profiles(cell)
    moments = cut(co_moments(df, numeric, target if numeric_target else None), "moments")
    variance = moments.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"v{i}").alias("variance")) for i, c in enumerate(names))))) if names else None
    if not target:
        association = None
    elif numeric_target:
        association = moments.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.abs(f"t{i}").alias("association")) for i, c in enumerate(names))))) if names else None
    else:
        parts = ([group_separation(df, numeric, target)] if numeric else []) + ([chi_association(cell)] if categorical else [])
        association = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    scored = profile
    for extra, name in ((variance, "variance"), (association, "association")):
        scored = scored.join(extra, "feature", "left") if extra is not None else scored.withColumn(name, F.lit(None).cast("double"))
    target_score = F.coalesce("association", F.lit(0.0))
    rules = [("missing_ratio", F.col("missing_ratio") > max_missing), ("distinct_count", F.col("distinct_count") < min_distinct), ("distinct_ratio", F.col("distinct_ratio") > max_cardinality)]
    rules += [("variance", F.col("feature").isin(names) & (F.coalesce("variance", F.lit(0.0)) <= min_variance))] + ([("target_score", target_score < min_target)] if target else [])
    scored = scored.select(
        "feature", "missing_ratio", "distinct_count", F.round(target_score, 8).alias("target_score"), F.round(F.greatest(F.lit(0.0), 1 - F.col("missing_ratio") + target_score), 8).alias("own"),
        F.array_compact(F.array(*(F.when(hit, F.lit(name)) for name, hit in rules))).alias("why"), F.col("feature").isin(*required).alias("needed") if required else F.lit(False).alias("needed"),
    )
    # of two columns that move together the one with the smaller score pays, of equal ones the later
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.abs(f"c{i}_{i + 1 + j}").alias("r")) for i, a in enumerate(names) for j, b in enumerate(names[i + 1 :])]
    if pairs:
        close = moments.select(F.inline(F.array(*pairs))).where(F.col("r") >= max_correlation)
        own = scored.select("feature", "own")
        close = close.join(own.toDF("a", "own_a"), "a").join(own.toDF("b", "own_b"), "b")
        paid = close.groupBy(F.when(F.col("own_a") >= F.col("own_b"), F.col("b")).otherwise(F.col("a")).alias("feature")).agg(F.round(F.max("r"), 8).alias("penalty"))
        scored = scored.join(paid, "feature", "left")
    else:
        scored = scored.withColumn("penalty", F.lit(None).cast("double"))
    penalty = F.coalesce("penalty", F.lit(0.0))
    fit = F.size("why") == 0
    scored = scored.withColumns({"penalty": penalty, "score": F.round(F.greatest(F.lit(0.0), F.col("own") - penalty), 8), "why": F.when(fit & (penalty > 0) & ~F.col("needed"), F.array(F.lit("correlation"))).otherwise(F.col("why"))})
    chosen = F.size("why") == 0
    order = Window.orderBy(F.desc("needed"), F.desc(chosen), F.desc("score"), "feature")  # a row for each column
    place = F.row_number().over(order)
    scored = scored.withColumn("rank", F.when(F.col("needed") | chosen, place))
    if max_features is not None:
        late = ~F.col("needed") & (F.col("rank") > max_features)
        scored = scored.withColumns({"why": F.when(late, F.array(F.lit("max_features"))).otherwise(F.col("why")), "rank": F.when(~F.coalesce(late, F.lit(False)), F.col("rank"))})
    status = F.when(F.col("needed"), "required").when(F.size("why") == 0, "selected").otherwise("rejected")
    return scored.select("feature", status.alias("status"), F.col("rank").cast("long").alias("rank"), "score", "target_score", "penalty", "missing_ratio", "distinct_count", F.array_join("why", ",").alias("reasons"))
