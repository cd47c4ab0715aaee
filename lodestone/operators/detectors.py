"""Walk-forward anomaly detectors: each value of a series is judged by the values before it, on tables and on streams alike.

A series keeps its last ``HISTORY`` values with their times, its number of values and
its exponential mean, never more. So a series of a table is cut into segments of ``SEGMENT``
rows, each with the ``HISTORY`` rows before it and the mean at their start, which any task
can judge alone. On a stream the state lies in Spark's state store; its task only sorts and
packs segments, and others judge them. Both call ``judged``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .ranges import numbered

EPSILON = 1e-12
#: Values of a series that are kept.
HISTORY = 512
#: Rows of a series that one task judges at a time.
SEGMENT = 16_384
#: Scores from which an anomaly is of a severity.
SEVERITY = ((8.0, "critical"), (5.0, "high"), (3.0, "medium"))
METHODS = ("static_threshold", "zscore", "robust_zscore", "iqr", "ewma", "rolling_stddev", "rate_of_change", "seasonal_baseline")
STATUSES, LEVELS = ("insufficient_baseline", "normal", "anomalous"), ("info", "low", "medium", "high", "critical")


@dataclass(frozen=True)
class Detector:
    """A method and its limits. ``window`` values before the judged one are its baseline, at least ``least`` values must be known; ``direction``: both, high or low; ``rate``: percent for rate_of_change; ``period`` and ``tolerance`` in seconds for seasonal_baseline."""

    method: str
    threshold: float = 3.0
    window: int = 100
    least: int = 20
    direction: str = "both"
    alpha: float = 0.3
    lower: float | None = None
    upper: float | None = None
    rate: float | None = None
    period: int = 86400
    tolerance: int = 300
    name: str | None = None

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"unknown method {self.method!r}")
        if not 0 < self.window <= HISTORY or self.threshold <= 0 and self.method != "static_threshold":
            raise ValueError("a window has 1 to HISTORY values, a threshold is positive")


@dataclass
class Series:
    """What is known of a series: its last values and their times, how many there were, and the exponential mean."""

    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    seen: int = 0
    mean: float | None = None


def _outside(x: np.ndarray, lower, upper, direction: str) -> np.ndarray:
    return (x < lower) & (direction != "high") | (x > upper) & (direction != "low")


def _beyond(x, lower, upper):
    """How far outside its bounds a value is, by the bound's size."""
    return np.where(x > upper, np.abs(x - upper) / np.maximum(np.abs(upper), 1), np.where(x < lower, np.abs(lower - x) / np.maximum(np.abs(lower), 1), 0.0))


def _rounded(x: np.ndarray) -> np.ndarray:
    """To six digits, halves away from 0."""
    y = np.abs(x) * 1e6
    whole = np.floor(y)
    out = np.copysign((whole + (y - whole >= 0.5)) / 1e6, x)
    return np.where(np.isfinite(out), out, x)


class _Past:
    """The values before each of n rows: ``held`` known ones, then the rows themselves, behind HISTORY places. Sums run from the oldest value to the newest, a place of all rows at a time."""

    def __init__(self, values: np.ndarray, times: np.ndarray, held: int, n: int):
        self.values, self.times, self.held, self.n = values, times, held, n

    def places(self, k: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each of the k places before a row, the oldest first: from which row on there is a value, and the values."""
        for j in range(HISTORY - k, HISTORY):
            a = max(0, HISTORY - self.held - j)
            if a < self.n:
                yield a, self.values[j + a : j + self.n]

    def count(self, k: int) -> np.ndarray:
        return np.minimum(self.held + np.arange(self.n), k)

    def mean(self, k: int, of=lambda a, v: v) -> np.ndarray:
        total = np.zeros(self.n)
        for a, v in self.places(k):
            total[a:] += of(a, v)
        return total / self.count(k)

    def spread(self, k: int) -> np.ndarray:
        """Standard deviations by running updates, exactly 0 for equal values."""
        mean, square, seen = np.zeros(self.n), np.zeros(self.n), np.zeros(self.n)
        for a, v in self.places(k):
            seen[a:] += 1
            d = v - mean[a:]
            mean[a:] += d / seen[a:]
            square[a:] += (v - mean[a:]) * d
        return np.sqrt(square / seen)

    def windows(self, k: int) -> np.ndarray:
        """Rows of the k values before each row, nan where there was none."""
        known = self.values[: HISTORY + self.n].copy()
        known[: HISTORY - self.held] = np.nan
        return np.lib.stride_tricks.sliding_window_view(known[HISTORY - k :], k)[: self.n]

    def seasonal(self, period: int, tolerance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number, mean and deviation of the kept values at the phase of the last one."""
        phase = (self.times % period).astype(np.int32)
        last = phase[HISTORY - 1 : HISTORY - 1 + self.n]
        seen, total, mean, square = (np.zeros(self.n) for _ in range(4))
        for j in range(HISTORY):
            a = max(0, HISTORY - self.held - j)
            if a >= self.n:
                continue
            gap = np.abs(last[a:] - phase[j + a : j + self.n])
            at = np.flatnonzero((gap <= tolerance) | (gap >= period - tolerance)) + a
            if not len(at):
                continue
            v, n, m = self.values[j + at], seen[at] + 1, mean[at]
            d = v - m
            m += d / n
            seen[at], mean[at] = n, m
            total[at] += v
            square[at] += (v - m) * d
        return seen, total / seen, np.sqrt(square / seen)


def _quantile(ordered: np.ndarray, count: np.ndarray, share: float) -> np.ndarray:
    """Of rows in order with nan behind ``count`` values, linear between neighbours."""
    rows, place = np.arange(len(ordered)), np.maximum(count - 1, 0) * share
    low = np.floor(place).astype(int)
    a, b = ordered[rows, low], ordered[rows, np.ceil(place).astype(int)]
    return a + (b - a) * (place - low)


def _judge(d: Detector, x: np.ndarray, past: _Past, means: np.ndarray):
    """anomalous, score, expected, lower, upper of the values x; what is said of rows without a baseline does not count."""
    none = np.full(len(x), np.nan)
    if d.method == "static_threshold":
        lower, upper = -np.inf if d.lower is None else d.lower, np.inf if d.upper is None else d.upper
        bounds = [np.full(len(x), np.nan if b is None else b) for b in (d.lower, d.upper)]
        return _outside(x, lower, upper, d.direction), _beyond(x, lower, upper), none, *bounds
    if d.method == "rate_of_change":
        last = past.values[HISTORY - 1 : HISTORY - 1 + len(x)]
        change = (x - last) / np.maximum(np.abs(last), EPSILON) * 100
        limit = d.rate if d.rate is not None else d.threshold * 100
        return _outside(change, -limit, limit, d.direction), np.abs(change) / max(limit, EPSILON), last, none, none
    count = past.count(d.window)
    if d.method == "iqr":
        ordered = np.sort(past.windows(d.window), axis=1)
        q1, middle, q3 = (_quantile(ordered, count, share) for share in (0.25, 0.5, 0.75))
        lower, upper = q1 - d.threshold * (q3 - q1), q3 + d.threshold * (q3 - q1)
        return _outside(x, lower, upper, d.direction), _beyond(x, lower, upper), middle, lower, upper
    if d.method == "robust_zscore":
        base = past.windows(d.window)
        middle = _quantile(np.sort(base, axis=1), count, 0.5)
        mad = _quantile(np.sort(np.abs(base - middle[:, None]), axis=1), count, 0.5)
        mad[mad == 0] = EPSILON
        z, spread = 0.6745 * (x - middle) / mad, d.threshold / 0.6745 * mad
        return _outside(z, -d.threshold, d.threshold, d.direction), np.abs(z), middle, middle - spread, middle + spread
    if d.method == "ewma":
        scale = past.mean(d.window, lambda a, v: np.abs(v - means[a:]))
        lower, upper = means - d.threshold * scale, means + d.threshold * scale
        return _outside(x, lower, upper, d.direction), np.abs(x - means) / np.maximum(scale, EPSILON), means, lower, upper
    mean, std = past.mean(d.window), past.spread(d.window)
    if d.method == "seasonal_baseline":  # the values at the phase of the last known time
        n, near_mean, near_std = past.seasonal(d.period, d.tolerance)
        mean, std = np.where(n < d.least, mean, near_mean), np.where(n < d.least, std, near_std)
    std[std == 0] = EPSILON
    lower, upper = mean - d.threshold * std, mean + d.threshold * std
    score = np.abs(x - mean) / np.maximum(std, EPSILON)
    if d.method == "zscore":
        return _outside((x - mean) / std, -d.threshold, d.threshold, d.direction), score, mean, lower, upper
    return _outside(x, lower, upper, d.direction), score, mean, lower, upper


JUDGED = "detector string, status string, severity string, score double, expected double, lower double, upper double, baseline_size long"


def _alpha(detectors: tuple[Detector, ...]) -> float | None:
    return next((d.alpha for d in detectors if d.method == "ewma"), None)


def followed(values: np.ndarray, times: np.ndarray, state: Series, alpha: float | None) -> tuple[np.ndarray, Series]:
    """The exponential mean before each value, and the series after them."""
    means, mean = np.full(len(values), np.nan), state.mean
    if alpha is not None:
        for i, v in enumerate(values.tolist()):
            means[i] = np.nan if mean is None else mean
            mean = v if mean is None else alpha * v + (1 - alpha) * mean
    return means, Series(np.concatenate((state.values, values[-HISTORY:]))[-HISTORY:], np.concatenate((state.times, times[-HISTORY:]))[-HISTORY:], state.seen + len(values), mean)


def judged(values: np.ndarray, times: np.ndarray, state: Series, detectors: tuple[Detector, ...], chunk: int = 4096) -> Iterator[tuple[int, Series, list[pa.Array]]]:
    """(first row, the series behind the part, columns of JUDGED) for parts of the rows and each detector. Values come in their order, times in whole seconds."""
    statuses, levels = pa.array(STATUSES), pa.array(LEVELS)
    for s in range(0, len(values), chunk):
        x, t = values[s : s + chunk], times[s : s + chunk]
        held, seen = len(state.values), state.seen + np.arange(len(x))
        past = _Past(np.concatenate((np.zeros(HISTORY - held), state.values, x)), np.concatenate((np.zeros(HISTORY - held, np.int64), state.times, t)), held, len(x))
        means, state = followed(x, t, state, _alpha(detectors))
        for d in detectors:
            static = d.method == "static_threshold"
            ready = np.full(len(x), True) if static else (seen >= d.least) & (seen > 0)
            with np.errstate(all="ignore"):
                hit, points, *rest = _judge(d, x, past, means)
                hit, bounds = hit & ready, [_rounded(np.where(ready, b, np.nan)) for b in rest]
                level = np.where(hit, 1, 0) + sum((hit & (points >= at)).astype(int) for at, _ in SEVERITY)
                score = np.where(ready, _rounded(points), 0.0)
            yield s, state, [
                pa.array([d.name or d.method]).take(pa.array(np.zeros(len(x), np.int64))), statuses.take(pa.array(ready.astype(int) + hit)), levels.take(pa.array(level)), pa.array(score),
                *(pa.array(b, mask=np.isnan(b)) for b in bounds), pa.array(np.minimum(seen, HISTORY)),
            ]


_NAMES = [x.split()[0] for x in JUDGED.split(", ")]


def _starts(rows: DataFrame, alpha: float) -> DataFrame:
    """_series, _seg, _mean: the exponential mean before the HISTORY rows that lead to each segment but the first, from sums over the blocks before."""
    left, block = 1 - alpha, F.expr(f"(_i + {HISTORY}) div {SEGMENT}")
    weight = F.pow(F.lit(left), (block + 1) * SEGMENT - HISTORY - 1 - F.col("_i")) * F.when(F.col("_i") == 0, 1.0).otherwise(alpha)
    sums = rows.groupBy("_series", block.alias("_seg")).agg(F.sum(F.col("_value") * weight).alias("_c"))
    decay = left**SEGMENT
    reach = max(1, math.ceil(-745 / math.log(decay))) if decay > 0 else 1  # blocks after which doubles hold nothing of a value
    before = F.collect_list("_c").over(Window.partitionBy("_series").orderBy("_seg").rowsBetween(-reach, -1))
    return sums.select("_series", "_seg", F.aggregate(before, F.lit(0.0), lambda m, c: m * decay + c).alias("_mean")).where("_seg > 0")


def _ready(df: DataFrame, by: list[str], ts: str, value: str) -> tuple:
    """Rows that are judged, and the columns of series, whole seconds (the nearest ones) and value."""
    v, at = F.col(value).cast("double"), F.col(ts).cast("timestamp")
    rows = df.where(F.col(ts).isNotNull() & v.isNotNull() & (F.abs(v) < float("inf")))
    return rows, [F.to_json(F.struct(*by)).alias("_series"), F.rint(F.unix_micros(at) / 1e6).cast("long").alias("_seconds"), v.alias("_value")]


def walk_forward(df: DataFrame, by: list[str], ts: str, order: list[str], value: str, detectors: list[Detector], keep: list[str]) -> DataFrame:
    """keep and, for each detector, its judgement of the row: one row out for each row and detector.

    Rows without time or a finite value are left out, as values that are skipped. Null
    keys are a series of their own. Infinite bounds and unknown ones are null.
    """
    specs = tuple(detectors)
    alpha = _alpha(specs)
    ready, own = _ready(df, by, ts, value)
    rows = numbered(ready.select(*keep, F.struct(F.col(ts), *order).alias("_at"), *own), ["_series"], ["_at"]).drop("_at", "_n")
    seg = F.expr(f"_i div {SEGMENT}")
    leads = F.col("_i") % SEGMENT >= SEGMENT - HISTORY  # rows that the next segment looks back on
    dealt = rows.select("*", F.explode(F.when(leads, F.array(seg, seg + 1)).otherwise(F.array(seg))).alias("_seg")).withColumn("_lead", F.col("_seg") > seg)
    dealt = dealt.join(_starts(rows, alpha), ["_series", "_seg"], "left") if alpha is not None else dealt.withColumn("_mean", F.lit(None).cast("double"))
    dealt = dealt.repartition("_series", "_seg").sortWithinPartitions("_series", "_seg", "_i").select(*keep, "_series", "_seg", "_lead", "_mean", "_seconds", "_value")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, state = None, Series()
        for batch in batches:
            if not batch.num_rows:
                continue
            names, seg, lead = batch["_series"].dictionary_encode(), batch["_seg"].to_numpy(), batch["_lead"].to_numpy(zero_copy_only=False)
            code, values, times = names.indices.to_numpy(), batch["_value"].to_numpy(), batch["_seconds"].to_numpy()
            cut = np.flatnonzero((code[1:] != code[:-1]) | (seg[1:] != seg[:-1]) | (lead[1:] != lead[:-1])) + 1
            for s, e in zip(np.append(0, cut).tolist(), np.append(cut, batch.num_rows).tolist(), strict=True):
                now = names.dictionary[code[s]].as_py(), int(seg[s])
                if now != who:  # a segment begins with the rows that lead to it
                    who, state = now, Series(seen=max(0, now[1] * SEGMENT - HISTORY), mean=batch["_mean"][s].as_py())
                if lead[s]:
                    _, state = followed(values[s:e], times[s:e], state, alpha)
                    continue
                for at, state, columns in judged(values[s:e], times[s:e], state, specs):  # noqa: B020
                    yield pa.RecordBatch.from_arrays([*(batch[c].slice(s + at, len(columns[0])) for c in keep), *columns], names=[*keep, *_NAMES])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return dealt.mapInArrow(scan, f"{kinds}, {JUDGED}")


STATE = "values array<double>, times array<long>, seen long, mean double"


def stream_walk_forward(stream: DataFrame, by: list[str], ts: str, order: list[str], value: str, detectors: list[Detector], keep: list[str], lateness: str, ttl_seconds: int) -> DataFrame:
    """walk_forward on a stream: a series' state outlives its batches, and is dropped when the watermark passes its last row by ``ttl_seconds``.

    Rows of one batch are taken in order; what comes in a later batch counts as later. The
    task of a series puts its batch in order, follows its state and packs segments, each with
    the state before it; these are dealt to all tasks to be judged.
    """
    specs = tuple(detectors)
    alpha = _alpha(specs)
    held = [c for c in keep if c != ts]
    rows, own = _ready(stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness), by, ts, value)
    rows = rows.select(F.col(ts), *(F.col(c) for c in dict.fromkeys([*held, *order]) if c != ts), *own)
    columns = ([ts] if ts in keep else []) + held
    tasks = max(2, int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions")), stream.sparkSession.sparkContext.defaultParallelism)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        values, times, seen, mean = state.get if state.exists else ([], [], 0, None)
        series = Series(np.array(values, float), np.array(times, np.int64), seen, mean)
        new = pd.concat([b.drop(columns="_series") for b in batches], ignore_index=True).sort_values([ts, *order], kind="stable", ignore_index=True)
        for s in range(0, len(new), SEGMENT):
            part = new.iloc[s : s + SEGMENT]
            sink = pa.BufferOutputStream()
            table = pa.Table.from_pandas(part[[*columns, "_seconds", "_value"]], preserve_index=False)
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            yield pd.DataFrame({"values": [series.values], "times": [series.times], "seen": [series.seen], "mean": [np.nan if series.mean is None else series.mean], "rows": [sink.getvalue().to_pybytes()]})
            _, series = followed(part["_value"].to_numpy(float), part["_seconds"].to_numpy(np.int64), series, alpha)
        state.update((series.values.tolist(), series.times.tolist(), series.seen, series.mean))
        state.setTimeoutTimestamp(max((int(series.times.max()) + ttl_seconds) * 1000, state.getCurrentWatermarkMs() + 1))

    types = [to_arrow_type(rows.schema[c].dataType) for c in columns]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values, times, seen, mean, packed in zip(*(batch[c] for c in ("values", "times", "seen", "mean", "rows")), strict=True):
                mean = mean.as_py()
                state = Series(np.array(values.as_py(), float), np.array(times.as_py(), np.int64), seen.as_py(), None if mean is None or math.isnan(mean) else mean)
                part = pa.ipc.open_stream(packed.as_buffer()).read_all().combine_chunks()
                kept = [part[c].combine_chunks().cast(t) for c, t in zip(columns, types, strict=True)]
                for at, _, found in judged(part["_value"].to_numpy(), part["_seconds"].to_numpy(), state, specs):
                    yield pa.RecordBatch.from_arrays([*(c.slice(at, len(found[0])) for c in kept), *found], names=[*columns, *_NAMES])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    packed = rows.groupBy("_series").applyInPandasWithState(step, f"{STATE}, rows binary", STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return packed.withColumn("_to", F.xxhash64("rows")).repartition(tasks, "_to").mapInArrow(judge, f"{kinds}, {JUDGED}")


def policies(results: DataFrame, least: str = "low", confirm: int = 1) -> DataFrame:
    """keep columns of walk_forward's rows, once for each row: its detectors that agree, the highest score and severity among them, for rows that at least ``confirm`` detectors call anomalous with ``least`` severity or more."""
    rank = F.array_position(F.array(*(F.lit(x) for x in ("info", "low", "medium", "high", "critical"))), F.col("severity"))
    own = [c for c in results.columns if c not in {x.split()[0] for x in JUDGED.split(", ")}]
    hits = results.where((F.col("status") == "anomalous") & (rank >= {"low": 2, "medium": 3, "high": 4, "critical": 5}[least]))
    out = hits.groupBy(*own).agg(F.count("*").alias("agreeing"), F.max("score").alias("top_score"), F.max_by("severity", rank).alias("top_severity"), F.array_join(F.sort_array(F.collect_list("detector")), ",").alias("detectors"))
    return out.where(F.col("agreeing") >= confirm)
