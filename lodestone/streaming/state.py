"""State of entities on a stream: what each did lately, forgotten after a time to live."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "entity string, ts timestamp, value double, label string, n_recent long, sum_recent double, is_new_label boolean"
STATE = "times array<long>, sums array<double>, labels array<string>, seen array<long>"


def velocity(stream: DataFrame, entity: str, ts: str, value: str, label: str, seconds: int, ttl_seconds: int, lateness: str) -> DataFrame:
    """Each event with its entity's events and sum of the last ``seconds`` (itself included, both ends inside) and whether its label is new.

    A label is new if the entity has had another one within ``ttl_seconds`` but not this one.
    Events of one batch are taken in time order; one behind the watermark is left out,
    as are rows without entity or time; a null value counts 0, a null label is never new. The state of an entity holds
    its events of ``seconds`` and one time for each label of ``ttl_seconds``, and is dropped
    when the watermark passes its last event by ``ttl_seconds``.
    """
    window, ttl = seconds * 1_000_000, ttl_seconds * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held_times, held_sums, labels, seen = map(list, state.get) if state.exists else ([], [], [], [])
        known = dict(zip(labels, seen, strict=True))
        newest = max(seen, default=None)
        new = pd.concat(list(batches)).sort_values(["ts", "value", "label"], kind="stable")
        at, values = new["at"].to_numpy(np.int64), new["value"].fillna(0.0).to_numpy(float)
        # both parts are sorted: counts and sums of a window are differences of running ones, extended so that they leave no trace
        order = np.argsort(held_times, kind="stable")
        old, own = np.array(held_times, np.int64)[order], np.concatenate(([0], np.cumsum(np.array(held_sums, np.longdouble)[order])))
        run = np.concatenate(([0], np.cumsum(values.astype(np.longdouble))))
        lo, hi, begin, end = np.searchsorted(old, at - window), np.searchsorted(old, at, "right"), np.searchsorted(at, at - window), np.arange(1, len(at) + 1)
        fresh = []
        for t, name in zip(at.tolist(), new["label"], strict=True):
            name = None if pd.isna(name) else name
            fresh.append(name is not None and newest is not None and newest >= t - ttl and known.get(name, t - ttl - 1) < t - ttl)
            if name is not None:
                known[name] = max(t, known.get(name, t))
                newest = max(t, known[name] if newest is None else newest)
        last = int(max(at[-1], old[-1] if len(old) else at[-1]))
        times, sums = np.concatenate((old, at)), np.concatenate((np.array(held_sums, float)[order], values))
        kept, names = times >= last - window, [k for k, t in known.items() if t >= last - ttl]
        state.update((times[kept].tolist(), sums[kept].tolist(), names, [known[k] for k in names]))
        state.setTimeoutTimestamp(max(last // 1000 + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        n, total = hi - lo + end - begin, (own[hi] - own[lo] + run[end] - run[begin]).astype(float)
        yield pd.DataFrame({"entity": key[0], "ts": new["ts"].to_numpy(), "value": values, "label": new["label"].to_numpy(), "n_recent": n, "sum_recent": total, "is_new_label": fresh})

    rows = stream.where(F.col(entity).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(entity).cast("string").alias("entity"), F.col(ts).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("value"), F.col(label).cast("string").alias("label"),
    )
    rows = rows.withWatermark("ts", lateness).withColumn("at", F.unix_micros("ts"))
    return rows.groupBy("entity").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
