"""Isolation forest and alerts with a cooldown."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _average_path(n):
    """The mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        long = 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def grown(points: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """One isolation tree as arrays: split column (-1 at a leaf), cut, left child (the right one follows it), depth credited to a leaf."""
    column, cut, left, path = [-1], [0.0], [0], [0.0]
    limit = math.ceil(math.log2(max(2, len(points))))
    todo = [(0, points, 0)]
    while todo:
        node, p, depth = todo.pop()
        low, high = (p.min(0), p.max(0)) if len(p) else (np.zeros(points.shape[1]),) * 2
        wide = np.flatnonzero(high > low)
        if depth >= limit or len(p) < 2 or not len(wide):
            path[node] = depth + float(_average_path(len(p)))
            continue
        c = int(rng.choice(wide))
        at = float(rng.uniform(low[c], high[c]))
        column[node], cut[node], left[node] = c, at, len(column)
        for part in (p[p[:, c] < at], p[p[:, c] >= at]):
            todo.append((len(column), part, depth + 1))
            column.append(-1), cut.append(0.0), left.append(0), path.append(0.0)
    return {"column": np.array(column), "cut": np.array(cut), "left": np.array(left), "path": np.array(path)}


def depths(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The path length of every row of x: all rows go down one level a round."""
    node = np.zeros(len(x), dtype=np.int64)
    while (inner := np.flatnonzero(tree["column"][node] >= 0)).size:
        at = node[inner]
        node[inner] = tree["left"][at] + (x[inner, tree["column"][at]] >= tree["cut"][at])
    return tree["path"][node]


def isolation_forest(df: DataFrame, key: str, columns: list[str], trees: int = 100, points: int = 256, share: float = 0.05, seed: int = 42) -> DataFrame:
    """df and ``isolation`` (0 to 1, higher is stranger) and ``is_outlier`` (the ``share`` of rows with the highest scores, approximately).

    Each tree is grown on ``points`` rows; trees * points rows, the first by a hash of the
    key, are all that the driver reads, at any size of df. Scores come from the forest
    in Arrow batches over all rows. A row with a null or infinite value has null in both;
    without any whole row all are null. The cut is Spark's approximate percentile.
    """
    whole = " AND ".join(f"`{c}` IS NOT NULL AND abs(double(`{c}`)) < double('infinity')" for c in columns)
    values = [F.col(c).cast("double") for c in columns]
    drawn = df.where(whole).orderBy(F.xxhash64(F.lit(seed), F.col(key).cast("string")), key).limit(trees * points).select(*values).toPandas().to_numpy(dtype=float)
    rng = np.random.default_rng(seed)
    size = min(points, len(drawn))
    forest = [grown(drawn[rng.choice(len(drawn), size, replace=False)], rng) for _ in range(trees)] if size else []
    norm = max(float(_average_path(size)), 1e-12)

    @F.pandas_udf("double")
    def score(*series: pd.Series) -> pd.Series:
        x = np.column_stack([s.to_numpy(dtype=float) for s in series])
        ok = np.isfinite(x).all(1)
        out = np.full(len(x), np.nan)
        if forest and ok.any():
            out[ok] = np.exp2(-np.mean([depths(t, x[ok]) for t in forest], axis=0) / norm)
        return pd.Series(out)

    scored = df.withColumn("isolation", F.nanvl(score(*values), F.lit(None).cast("double")))
    edge = scored.agg(F.percentile_approx("isolation", 1 - share, 10000).alias("_edge"))
    return scored.crossJoin(F.broadcast(edge)).withColumn("is_outlier", F.col("isolation") > F.col("_edge")).drop("_edge")


def firing(times: np.ndarray, last: int | None, wait: int) -> np.ndarray:
    """The places of the times (sorted) that fire: each one at least ``wait`` after the one that fired before it. Jumps from one to the next."""
    out, at = [], 0 if last is None else int(np.searchsorted(times, last + wait))
    while at < len(times):
        out.append(at)
        at = int(np.searchsorted(times, times[at] + wait))
    return np.array(out, np.int64)


def fires(df: DataFrame, identity: list[str], micros: Column, wait: int, ties: Column, among: Column) -> DataFrame:
    """df with ``fired``: of the rows of one identity that ``among`` holds for, by time and ties, those at least ``wait`` microseconds after the one that fired before.

    The rows of one identity are sorted in one task and read as a stream of batches, of
    which only the last fired time is kept; a row without time never fires.
    """
    kinds = df.withColumn("fired", F.lit(False)).schema
    ready = df.withColumns({"_cool_at": micros, "_cool_among": F.coalesce(among, F.lit(False)) & micros.isNotNull(), "_cool_key": F.xxhash64(*identity), "_cool_id": F.to_json(F.struct(*identity)), "_cool_tie": ties})
    ready = ready.repartition("_cool_key").sortWithinPartitions("_cool_key", "_cool_id", "_cool_at", "_cool_tie").drop("_cool_tie")

    def fire(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, last = None, None
        for b in batches:
            fired = np.zeros(len(b), dtype=bool)
            use = np.flatnonzero(b["_cool_among"].to_numpy(dtype=bool))
            names, times = b["_cool_id"].to_numpy()[use], b["_cool_at"].to_numpy()[use].astype(np.int64)
            cut = np.flatnonzero(names[1:] != names[:-1]) + 1
            for s, e in zip(np.append(0, cut), np.append(cut, len(use)), strict=True):
                if s == e:
                    continue
                if names[s] != who:
                    who, last = names[s], None
                hit = firing(times[s:e], last, wait)
                fired[use[s:e][hit]] = True
                last = int(times[s:e][hit[-1]]) if len(hit) else last
            b = b.drop(columns=["_cool_at", "_cool_among", "_cool_key", "_cool_id"])
            b["fired"] = fired
            yield b[kinds.names]

    return ready.mapInPandas(fire, kinds)


def cooled(df: DataFrame, identity: list[str], ts: str, seconds: int, ties: Column) -> DataFrame:
    """The alerts that fire: an identity is silent for ``seconds`` after its last fired alert. A null time never fires."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return fires(df.where(F.col(ts).isNotNull()), identity, micros, seconds * 1_000_000, ties, F.lit(True)).where("fired").drop("fired")
