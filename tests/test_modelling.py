"""Feature selection, detectors, states, own aggregates, metric formulas and range quantiles against plain versions, with nulls, ties, empty tables and hot groups."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import detectors as D
from lodestone.operators import metrics as M
from lodestone.operators import ranges as R
from lodestone.operators import selection as L
from lodestone.operators import states as S
from lodestone.operators import stats as T
from lodestone.operators.aggregate import Agg
from lodestone.session import cut
from lodestone.streaming import windows as W


def test_selection_reasons_and_order(spark):
    rows = [(float(k), 2.0 * k + 1, float(k % 7), 1.0, None if k % 30 else 1.0, "ab"[k % 2], "x", "pq"[k % 2]) for k in range(90)]
    df = spark.createDataFrame(rows, "a double, b double, c double, flat double, rare double, kind string, one string, t string")
    got = {r.feature: r for r in L.select_features(df, ["a", "b", "c", "flat", "rare"], ["kind", "one"], "t", min_distinct=2).collect()}
    assert got["b"].reasons == "correlation" and got["b"].penalty == 1.0 and got["a"].status == "selected"  # of equal scores the later one pays
    assert got["flat"].reasons == "distinct_count,variance" and got["rare"].reasons == "missing_ratio,distinct_count,variance" and got["one"].reasons == "distinct_count"
    assert got["kind"].target_score == 0.5 and got["kind"].rank == 1
    kept = L.select_features(df, ["a", "b", "c"], [], "t", required=("b",), max_features=2).collect()
    assert {r.feature: (r.status, r.rank) for r in kept} == {"b": ("required", 1), "a": ("selected", 2), "c": ("rejected", None)}
    assert L.select_features(df.limit(0), ["a"], ["kind"], "t").count() == 0
    nothing = L.select_features(spark.createDataFrame([(None, None, None)], "a double, k string, t string"), ["a"], ["k"], "t").collect()
    assert all(r.status == "rejected" and r.target_score == 0 for r in nothing)


def plain_walk(values, times, d):
    """One detector over one series, value by value."""
    out, known, mean = [], [], None
    for x, t in zip(values, times):
        base = [v for v, _ in known][-d.window :]
        hit, score = None, 0.0
        if d.method == "static_threshold" or len(known) >= d.least and known:
            lo = hi = None
            if d.method == "zscore":
                m, s = statistics.fmean(base), statistics.pstdev(base) or 1e-12
                hit, score = abs((x - m) / s) > d.threshold, abs(x - m) / s
            elif d.method == "robust_zscore":
                m = statistics.median(base)
                s = statistics.median([abs(v - m) for v in base]) or 1e-12
                hit, score = abs(0.6745 * (x - m) / s) > d.threshold, abs(0.6745 * (x - m) / s)
            elif d.method == "ewma":
                s = statistics.fmean([abs(v - mean) for v in base])
                hit, score = x < mean - d.threshold * s or x > mean + d.threshold * s, abs(x - mean) / max(s, 1e-12)
            elif d.method == "seasonal_baseline":
                last = known[-1][1]
                near = [v for v, u in known[-D.HISTORY :] if (last - u) % d.period <= d.tolerance or abs((last - u) % d.period - d.period) <= d.tolerance]
                base = near if len(near) >= d.least else base
                m, s = statistics.fmean(base), statistics.pstdev(base) or 1e-12
                hit, score = x < m - d.threshold * s or x > m + d.threshold * s, abs(x - m) / s
            else:
                lo, hi = d.lower, d.upper
                hit = lo is not None and x < lo or hi is not None and x > hi
                score = abs(x - hi) / max(abs(hi), 1) if hi is not None and x > hi else abs(lo - x) / max(abs(lo), 1) if lo is not None and x < lo else 0.0
        out.append(("insufficient_baseline" if hit is None else "anomalous" if hit else "normal", score))
        known.append((x, t))
        mean = x if mean is None else d.alpha * x + (1 - d.alpha) * mean
    return out


WALK = [D.Detector("zscore", 2.0, 25, 5), D.Detector("robust_zscore", 3.5, 25, 5), D.Detector("ewma", 2.0, 25, 5), D.Detector("seasonal_baseline", 2.0, 25, 3, period=3600, tolerance=60), D.Detector("static_threshold", upper=12.0)]


def series(n, seed):
    rng = np.random.default_rng(seed)
    v = np.round(rng.normal(10, 1, n), 3)
    v[rng.integers(0, n, max(1, n // 40))] += 9
    v[n // 3 : n // 3 + 30] = 4.0  # no spread at all
    return v.tolist(), (np.arange(n) * 600 + rng.integers(0, 50, n)).tolist()


@pytest.fixture(scope="module")
def walked():
    """Rows (id, key, seconds, value) of three series, the first longer than the kept history."""
    out, want = [], {}
    for key, n in (("long", 2600), ("short", 3), (None, 90)):
        v, t = series(n, n)
        ids = range(len(out), len(out) + n)
        out += list(zip(ids, [key] * n, t, v))
        for d in WALK:
            want |= {(i, d.method): w for i, w in zip(ids, plain_walk(v, t, d))}
    return out, want


def _frame(spark, rows):
    return spark.createDataFrame(rows, "id long, key string, s long, value double").withColumn("ts", F.timestamp_seconds("s"))


def _same(rows, want):
    got = {(r.id, r.detector): r for r in rows}
    assert got.keys() == want.keys()
    for k, (status, score) in want.items():
        assert got[k].status == status and (status == "insufficient_baseline" or math.isclose(got[k].score, score, rel_tol=1e-4, abs_tol=2e-6)), (k, got[k], status, score)


def test_walk_forward_is_the_plain_loop(spark, walked):
    rows, want = walked
    df = _frame(spark, rows + [(-1, "long", 5, None), (-2, "long", None, 1.0), (-3, "long", 7, float("inf")), (-4, "long", 7, float("nan"))])
    _same(D.walk_forward(df, ["key"], "ts", ["id"], "value", WALK, ["id"]).collect(), want)
    assert D.walk_forward(df.limit(0), ["key"], "ts", ["id"], "value", WALK, ["id"]).count() == 0
    with pytest.raises(ValueError):
        D.Detector("nothing")


def test_a_stream_in_several_batches_is_the_same(spark, walked, tmp_path):
    rows, want = walked
    ordered = sorted(rows, key=lambda r: r[2])
    at, size = str(tmp_path), len(ordered) // 4 + 1
    for k in range(4):  # a file for each batch, in time
        _frame(spark, ordered[k * size : (k + 1) * size]).coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema(_frame(spark, ordered[:1]).schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    W.run_available(D.stream_walk_forward(stream, ["key"], "ts", ["id"], "value", WALK, ["id"], "1 day", 86400), f"{at}/out", f"{at}/checkpoint")
    _same(spark.read.parquet(f"{at}/out").collect(), want)


def test_policies_need_agreement(spark, walked):
    rows, want = walked
    walk = D.walk_forward(_frame(spark, rows), ["key"], "ts", ["id"], "value", WALK, ["id"])
    agreeing = {}
    for (i, _), (status, _) in want.items():
        agreeing[i] = agreeing.get(i, 0) + (status == "anomalous")
    got = {r.id: r.agreeing for r in D.policies(walk, "low", 3).collect()}
    assert got == {i: n for i, n in agreeing.items() if n >= 3} and got


def test_states_of_parts_merge_to_the_whole(spark):
    rng = np.random.default_rng(5)
    rows = [("ab"[k % 2] if k % 50 else None, int(k % 9), None if k % 17 == 0 else float(x)) for k, x in enumerate(rng.lognormal(3, 2, 20_000))] + [("empty", d, None) for d in range(3)]
    df = spark.createDataFrame(rows, "g string, day int, v double")
    stored = [cut(S.partial_states(df.where(F.col("day") == d), ["g"], "v")) for d in range(9)]
    states = stored[0]
    for s in stored[1:]:  # a day at a time: the merged past and the new day
        states = cut(S.merged_states(states.unionByName(s), ["g"]))
    got = {r.g: r for r in S.finished(states, ["g"], (0.5, 0.99)).collect()}
    assert got.keys() == {"a", "b", None, "empty"} and got["empty"].n == 0 and got["empty"].n_rows == 3 and got["empty"].mean is None and got["empty"].q50 is None
    for g in ("a", "b", None):
        v = np.array([x for k, _, x in rows if k == g and x is not None])
        r = got[g]
        assert r.n == len(v) and r.low == v.min() and r.high == v.max()
        assert math.isclose(r.mean, v.mean(), rel_tol=1e-12) and math.isclose(r.variance, v.var(ddof=1), rel_tol=1e-9)
        assert abs(r.n_distinct / len(set(v)) - 1) < 0.03
        for q in (0.5, 0.99):
            assert abs((v <= r[f"q{round(100 * q)}"]).mean() - q) <= 2 * R.sketch_error(S.QUANTILE_K) + 1 / len(v)


def test_own_aggregates_in_two_levels(spark):
    rows = [("hot", float(k % 1000) + 1) for k in range(60_000)] + [("few", 3.0), ("few", None), ("none", None), (None, 5.0), (None, 7.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r.g: r for r in S.aggregated(df, ["g"], {"geo": ("v", S.geometric_mean()), "trim": ("v", S.trimmed_mean(40))}).collect()}
    hot = np.sort([v for g, v in rows if g == "hot"])
    assert math.isclose(got["hot"].geo, np.exp(np.log(hot).mean())) and math.isclose(got["hot"].trim, hot[40:-40].mean())
    assert got["few"].geo == pytest.approx(3) and got["few"].trim is None and got["none"].geo is None and got[None].geo == pytest.approx(35**0.5)
    whole = S.aggregated(df, [], {"geo": ("v", S.geometric_mean())}).collect()
    assert len(whole) == 1 and S.aggregated(df.limit(0), ["g"], {"geo": ("v", S.geometric_mean())}).count() == 0


def test_metric_formulas(spark):
    df = spark.createDataFrame([("x", 4.0, 2), ("x", 6.0, 0), ("y", None, 1)], "g string, v double, k int")
    leaves = [M.Metric("total", Agg("total", "sum", "v")), M.Metric("n", Agg("n", "count")), M.Metric("k", Agg("k", "sum", "k"))]
    made = [M.Metric("per", formula="total / n"), M.Metric("twice", formula="-per * -2 + max(n, k, 0)"), M.Metric("bad", formula="log(total - 10) + 1"), M.Metric("root", formula="sqrt(0 - n)"), M.Metric("rest", formula="(0 - n) % 3"), M.Metric("flat", formula="round(7 / 3, 2)")]
    got = {r.g: r for r in M.computed(df, ["g"], made[::-1] + leaves).collect()}
    assert (got["x"].per, got["x"].twice, got["x"].bad, got["x"].root, got["x"].rest, got["x"].flat) == (5.0, 12.0, None, None, 1.0, 2.33)
    assert got["y"].per == 0 and [f for f in M.computed(df, ["g"], made + leaves, ["twice"]).columns] == ["g", "twice"]
    for text in ("__import__('os')", "total.real", "[1]", "total if n else 1", "lambda: 1", "'a'", "True", "min()", "abs(1, 2)", "unknown + 1", "total +"):
        with pytest.raises(M.UnsafeExpression):
            M.computed(df, ["g"], [*leaves, M.Metric("m", formula=text)])
    with pytest.raises(ValueError, match="cycle"):
        M.ordered([M.Metric("a", formula="b + 1"), M.Metric("b", formula="a * 2")])


def test_range_quantiles_and_ranks(spark):
    rng = np.random.default_rng(9)
    rows = [("hot", float(x)) for x in rng.integers(0, 300, 9000)] + [("one", 5.0), (None, 1.0), (None, 2.0), ("none", None), ("hot", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in R.quantiles(df, ["g"], F.col("v"), {"a": 0.25, "b": 0.5, "c": 0.999}).collect()}
    hot = np.array([v for g, v in rows if g == "hot" and v is not None])
    assert [got["hot"][c] for c in "abc"] == pytest.approx(np.quantile(hot, [0.25, 0.5, 0.999]).tolist())
    assert got["one"].b == 5 and got[None].b == 1.5 and "none" not in got
    assert R.quantiles(df, [], F.col("v"), {"m": 0.5}).first().m == np.median([v for _, v in rows if v is not None])
    assert R.quantiles(df.where("g = 'none'"), [], F.col("v"), {"m": 0.5}).count() == 0
    for n in (1, 2, 3, 7, 10, 101, 5000, 40_000):  # small groups, ties, and more rows than a coarse sketch tells apart
        values = np.concatenate((rng.normal(0, 1, n - n // 3), np.full(n // 3, 0.25)))
        made = spark.createDataFrame([(float(x),) for x in values], "v double")
        for accuracy in (10, 10_000):
            ps = {f"q{i}": p for i, p in enumerate((0.0, 0.01, 0.25, 0.5, 0.9, 1.0))}
            assert list(R.quantiles(made, [], F.col("v"), ps, accuracy).first()) == pytest.approx(np.quantile(values, list(ps.values())).tolist()), (n, accuracy)
    numbers = R.numbered(df, ["g"], ["v"]).collect()
    assert sorted(r._i for r in numbers if r.g == "hot") == list(range(9001)) and all(r._n == 9001 for r in numbers if r.g == "hot")
    import pandas as pd

    ranks = R.average_ranks(df.where("v is not null"), ["g"], "v", "rank").toPandas()
    want = pd.DataFrame([r for r in rows if r[1] is not None], columns=["g", "v"])
    want["rank"] = want.groupby("g", dropna=False).v.rank()
    key = lambda x: sorted((str(g), v, r) for g, v, r in x[["g", "v", "rank"]].itertuples(index=False))
    assert key(ranks) == key(want)


def test_statistics_of_constant_and_empty_columns(spark):
    df = spark.createDataFrame([("a", 1.0, k * 1.0) for k in range(5)] + [("b", None, None)], "g string, x double, y double")
    assert T.correlations(df, ["x", "y"]).first().r == 0 and {r.rho for r in T.spearman(df, ["g"], "x", "y").collect()} == {0.0}
    got = {r.g: r for r in T.describe(df, ["g"], "y").collect()}
    assert got["a"].median == 2 and got["b"].n == 0 and got["b"].median is None
