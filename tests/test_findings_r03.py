"""Findings of the third review: ties, exact pairs, rounding, and work that grows with the input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import detectors as D
from lodestone.operators import finance as N
from lodestone.operators import graph as G
from lodestone.operators import joins as J
from lodestone.operators import materialise as Z
from lodestone.operators import selection as L
from lodestone.operators import vectors as V


def test_features_as_of_decide_ties_and_skip_unknown(spark, tmp_path):
    kind = "who int, ts timestamp_ntz, x double, k long"
    rows = spark.createDataFrame([(1, 0, 5.0, 9), (1, 0, 7.0, 2), (1, 0, 6.0, 4), (2, 0, 1.0, 1), (2, 1, None, 2)], "who int, d int, x double, k long")
    rows = rows.selectExpr("who", "timestamp_ntz'2024-01-01' + make_dt_interval(d) AS ts", "x", "k").to(spark.createDataFrame([], kind).schema)
    spine = rows.select("who", F.expr("timestamp_ntz'2024-01-09'").alias("ts")).distinct()
    for i, order in enumerate((["k"], [F.desc("k")])):  # whatever order they were stored in
        at = str(tmp_path / str(i))
        Z.write_chunk(rows.coalesce(1).sortWithinPartitions(*order), at, "v", ["who"], "ts", "c")
        got = {r.who: r.x for r in Z.as_of(spine, spark, at, "v", ["who"], "ts", ["x"], first=("k",), known=True).collect()}
        assert got == {1: 7.0, 2: 1.0}


def test_walk_rounds_halves_up_and_takes_the_nearest_second(spark):
    assert D._rounded(np.array([47.1215625, -47.1215625, np.nan, 1e300])).tolist()[:2] == [47.121563, -47.121563]
    season = D.Detector("seasonal_baseline", 2.0, 1, 1, period=100, tolerance=10)
    # the first value lies 10.4 and so 10 whole seconds from the last one's phase, as its half second counts up
    rows = spark.createDataFrame([(1, 0.6, 10.0), (2, 11.0, 40.0), (3, 12.0, 25.0)], "id int, sec double, v double").withColumn("ts", F.timestamp_micros((F.col("sec") * 1e6).cast("long")))
    got = {r.id: r.expected for r in D.walk_forward(rows, [], "ts", ["id"], "v", [season], ["id"]).collect()}
    assert got == {1: None, 2: 10.0, 3: 25.0}


def test_walk_in_segments_is_the_walk_in_one(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, "ab"[i % 7 == 0], i // 3, float(v)) for i, v in enumerate(rng.lognormal(3, 1, 6000))]
    df = spark.createDataFrame(rows, "id long, k string, sec long, v double").withColumn("ts", F.timestamp_seconds("sec"))
    specs = [D.Detector("ewma", 2.0, 30, 10, alpha=0.001), D.Detector("zscore", 2.0, 30, 10), D.Detector("seasonal_baseline", 2.0, 30, 10, period=300, tolerance=9)]
    walk = lambda: {(r.id, r.detector): (r.status, r.severity, r.expected, r.baseline_size, r.score) for r in D.walk_forward(df, ["k"], "ts", ["id"], "v", specs, ["id"]).collect()}
    whole = walk()
    monkeypatch.setattr(D, "SEGMENT", 600)
    parts = walk()
    assert whole.keys() == parts.keys() and len(parts) == 18_000
    for k, w in whole.items():
        assert parts[k][:2] == w[:2] and parts[k][3] == w[3] and parts[k][2] == pytest.approx(w[2], abs=2e-6) and parts[k][4] == pytest.approx(w[4], abs=2e-6), k


def test_all_pairs_are_all_pairs_copies_included(spark):
    x = np.random.default_rng(4).standard_normal((230, 8)).astype(np.float32).astype(float)
    x[200:] = x[:30]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8)]
    unit = x / np.sqrt((x**2).sum(1))[:, None]
    s = unit @ unit.T
    want = {(i, j) for i in range(230) for j in range(i + 1, 230) if s[i, j] >= 0.6}
    got = V.all_pairs(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 0.6, block=60).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
    assert all(abs(r.score - s[r.a, r.b]) < 1e-12 for r in got)


def test_fuzzy_matches_take_a_distance_once_for_equal_texts(spark):
    texts = ["red bolt", "red bolts", "blue ring", "", None]
    rows = [(i, texts[i % 5], None if i == 7 else "xy"[i % 2]) for i in range(40)]
    got = J.fuzzy_matches(spark.createDataFrame(rows, "k int, t string, b string"), "k", "t", F.col("b"), 0.8)
    alike = lambda p, q: p is not None and q is not None and (p == q or {p, q} == {"red bolt", "red bolts"})
    want = {(i, j) for i, t, b in rows for j, u, c in rows if i < j and b is not None and b == c and alike(t, u)}
    assert {(r.a, r.b) for r in got.collect()} == want
    assert "levenshtein" not in got._jdf.queryExecution().toString()


def test_bank_matches_to_a_cent_whatever_the_rounding(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "id long, amount double, date string, text string").withColumn("date", F.to_date("date"))
    got = N.bank_matches(rows((1, 0.0149999995, "2024-01-04", "a"), (2, 5.0, "2024-01-04", None)), rows((7, 0.025, "2024-01-07", "A"), (8, 5.01, "2024-01-01", "b"), (9, 5.011, "2024-01-04", "b")))
    assert {(r.statement_id, r.transaction_id, r.score) for r in got.collect()} == {(1, 7, 0.7), (2, 8, 0.5)}


def test_reach_computes_its_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    edges = spark.createDataFrame([(i, i + 1) for i in range(5)], "src long, dst long").mapInPandas(counted, "src long, dst long")
    got = {r.node: r.distance for r in G.reach(edges, spark.sql("SELECT 0L AS node")).collect()}
    assert got == {i: i for i in range(6)} and seen.value == 5


def test_small_files_are_worked_on_by_all_cores(spark, sf_dir):
    from lodestone.plans import modelling

    assert modelling._people(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_moments_are_taken_a_few_at_a_time(spark):
    x = np.random.default_rng(6).standard_normal((500, 5))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double, e double")
    plan = L.co_moments(df, list("abcde"), None)
    (row,) = plan.collect()
    assert all(abs(row[f"c{i}_{j}"] - np.corrcoef(x[:, i], x[:, j])[0, 1]) < 1e-12 for i in range(5) for j in range(i + 1, 5))
    assert all(abs(row[f"v{i}"] - x[:, i].var()) < 1e-12 for i in range(5)) and plan._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") > 1
