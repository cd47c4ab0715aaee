"""Aggregates whose state is kept: stored partial states that merge by key, and aggregates of one's own in two levels.

A stored state holds count, mean and squared deviations, minimum and maximum, a KLL
sketch for quantiles and a HyperLogLog sketch for distinct values. A day is added by
writing its states; the past is merged, never read again.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .ranges import beside

#: The sizes of the sketches: log2 of the registers for distinct values, k of the quantiles.
LOG_REGISTERS, QUANTILE_K = 14, 400


def partial_states(df: DataFrame, by: list[str], value: str, distinct: str | None = None) -> DataFrame:
    """by and the state of each group: ``n_rows``, and of its non-null values ``n``, ``mean``, ``m2``, ``low``, ``high``, ``ranks`` (KLL) and ``distinct`` (HLL, of another column if given)."""
    v = F.col(value).cast("double")
    d = F.col(distinct or value)
    n = F.count(v)
    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"), n.alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * n).alias("m2"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.when(n > 0, F.kll_sketch_agg_double(v, QUANTILE_K)).alias("ranks"), F.hll_sketch_agg(d.cast("string"), LOG_REGISTERS).alias("distinct"),
    )


def merged_states(states: DataFrame, by: list[str]) -> DataFrame:
    """States merged by key: a state again. Means and squared deviations by the pairwise formula around the common mean."""
    n = F.col("n")
    common = states.groupBy(*by).agg(F.try_divide(F.sum(n * F.col("mean")), F.sum(n)).alias("_mean"))
    d = F.col("mean") - F.col("_mean")
    return beside(states, common, by).groupBy(*by).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n").alias("n"), F.max("_mean").alias("mean"), F.sum(F.when(n > 0, F.col("m2") + n * d * d)).alias("m2"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_double("ranks", QUANTILE_K).alias("ranks"), F.hll_union_agg("distinct").alias("distinct"),
    )


def finished(states: DataFrame, by: list[str], shares: tuple[float, ...] = ()) -> DataFrame:
    """by, n_rows, n, total, mean, variance (sample), deviation, low, high, n_distinct (approximate), and q<percent> of each share (a value whose rank is right to ``ranges.sketch_error``)."""
    variance = F.when(F.col("n") > 1, F.col("m2") / (F.col("n") - 1))
    out = [F.col("n_rows"), F.col("n"), (F.col("mean") * F.col("n")).alias("total"), F.col("mean"), variance.alias("variance"), F.sqrt(variance).alias("deviation"), F.col("low"), F.col("high"), F.hll_sketch_estimate("distinct").alias("n_distinct")]
    out += [F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("ranks", F.lit(float(p)))).alias(f"q{round(100 * p)}") for p in shares]
    return states.select(*by, *out)


@dataclass(frozen=True)
class Aggregate:
    """An aggregate of one's own: ``init()`` gives a state, ``update(state, values)`` takes an array of float64 without nulls, ``merge(a, b)`` joins two states, ``finish(state)`` gives the result. States must stay small; they travel pickled."""

    init: Callable
    update: Callable
    merge: Callable
    finish: Callable
    result: str = "double"


#: States that a task holds before it hands them on.
HELD = 50_000


def aggregated(df: DataFrame, by: list[str], values: dict[str, tuple[str, Aggregate]]) -> DataFrame:
    """by and a column for each (column, Aggregate): states are made where the rows are, in Arrow batches, and only states are shuffled and merged.

    So a group of any size is one state a task before it meets itself. Null values are
    left out, null keys are a group; a group without values has what finish makes of init.
    """
    columns = {c for c, _ in values.values()}
    kinds = StructType([StructField(b, df.schema[b].dataType) for b in by])
    schema = StructType([*kinds, StructField("_states", _parse_datatype_string("binary"))])
    out = StructType([*kinds, *(StructField(n, _parse_datatype_string(a.result)) for n, (_, a) in values.items())])

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}

        def handed():
            frame = pd.DataFrame(list(held), columns=by, dtype=object)
            frame["_states"] = [pickle.dumps(s) for s in held.values()]
            held.clear()
            return frame

        for batch in batches:
            groups = batch.groupby(by, dropna=False, sort=False).indices if by else {(): np.arange(len(batch))}
            arrays = {c: batch[c].to_numpy(float) for c in columns}
            for key, at in groups.items():
                key = key if isinstance(key, tuple) else (key,)
                key = tuple(None if pd.isna(k) else k for k in key)
                own = held.setdefault(key, [a.init() for _, a in values.values()])
                for i, (c, a) in enumerate(values.values()):
                    x = arrays[c][at]
                    own[i] = a.update(own[i], x[~np.isnan(x)])
            if len(held) > HELD:
                yield handed()
        if held:
            yield handed()

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total = None
        for blob in frame["_states"]:
            part = pickle.loads(blob)
            total = part if total is None else [a.merge(x, y) for (_, a), x, y in zip(values.values(), total, part, strict=True)]
        done = [a.finish(s) for (_, a), s in zip(values.values(), total, strict=True)]
        return pd.DataFrame([[frame[b].iloc[0] for b in by] + done], columns=out.names)

    rows = df.select(*by, *(F.col(c).cast("double").alias(c) for c in sorted(columns - set(by))))
    return rows.mapInPandas(states, schema).groupBy(*by).applyInPandas(merge, out)


def geometric_mean() -> Aggregate:
    """exp of the mean logarithm of the positive values."""

    def update(s, x):
        x = x[x > 0]
        return s[0] + len(x), s[1] + float(np.log(x).sum())

    return Aggregate(lambda: (0, 0.0), update, lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: float(np.exp(s[1] / s[0])) if s[0] else None)


def trimmed_mean(k: int) -> Aggregate:
    """The mean without the k smallest and the k largest values; none of 2 k values or fewer."""

    def keep(low, high):
        return np.sort(low)[:k], np.sort(high)[::-1][:k]

    def update(s, x):
        return s[0] + len(x), s[1] + float(x.sum()), *keep(np.append(s[2], np.partition(x, k - 1)[:k] if len(x) > k else x), np.append(s[3], -np.partition(-x, k - 1)[:k] if len(x) > k else x))

    def merge(a, b):
        return a[0] + b[0], a[1] + b[1], *keep(np.append(a[2], b[2]), np.append(a[3], b[3]))

    def finish(s):
        return (s[1] - float(s[2].sum()) - float(s[3].sum())) / (s[0] - 2 * k) if s[0] > 2 * k else None

    return Aggregate(lambda: (0, 0.0, np.zeros(0), np.zeros(0)), update, merge, finish)
