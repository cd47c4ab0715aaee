"""Lag forecasts: features, steps and backtests against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import lagged as X

SPEC = X.Lags((1, 2, 5), (3, 6), season=4)


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(4)
    data = {g: (50 + 20 * np.sin(np.arange(n) / 3) + 10 * (np.arange(n) % 4) + rng.normal(0, 1, n)).round(3) for g, n in (("a", 80), ("b", 60), ("short", 4))}
    rows = [(g, 100 + 2 * k, float(v)) for g, xs in data.items() for k, v in enumerate(xs)] + [("a", None, 9.0)]
    return data, X.indexed(spark.createDataFrame(rows, "g string, p long, v double"), ["g"], "p", "v").cache()


def plain_features(xs, t):
    last = lambda w: np.array(xs[-w:])
    return [xs[-k] for k in SPEC.lags] + [f for w in SPEC.windows for f in (last(w).mean(), last(w).std())] + [t % 4]


def test_training_rows_and_step_features_agree(made):
    data, rows = made
    for r in X.training_rows(rows, ["g"], SPEC).collect():
        assert np.allclose([r[n] for n in SPEC.names], plain_features(data[r.g][: r.t].tolist(), r.t))
    assert X.training_rows(rows, ["g"], SPEC).count() == 80 + 60 - 2 * SPEC.depth


def test_tree_steps_are_the_plain_loop(spark, made):
    data, rows = made
    model = X.trees("forest", count=8, depth=3)(X.training_rows(rows, ["g"], SPEC), SPEC)
    got = {(r.g, r.step): (r.t, r.predicted) for r in X.forecast(rows, ["g"], model, SPEC, 3).collect()}
    assert {g for g, _ in got} == {"a", "b"}
    for g in ("a", "b"):
        xs = data[g].tolist()
        for step in (1, 2, 3):
            one = spark.createDataFrame([[float(f) for f in plain_features(xs, len(xs))]], SPEC.names)
            want = model(one).first().predicted
            assert got[g, step][0] == len(xs) and math.isclose(got[g, step][1], want, rel_tol=1e-9)
            xs.append(want)


def test_backtest_is_the_plain_loop(made):
    data, rows = made
    windows = X.folds(60, 3, SPEC)
    assert windows == [(30, 40), (40, 50), (50, 60)]
    got = X.backtest(rows.where("g <> 'short'"), ["g"], X.moving_average(3), SPEC, windows[:2]).collect()
    for r, (end, stop) in zip(sorted(got, key=lambda r: r.fold), windows):
        errors, actual = [], []
        for g in ("a", "b"):
            xs = data[g][:end].tolist()
            for t in range(end, stop):
                xs.append(np.mean(xs[-3:]))
                errors.append(xs[-1] - data[g][t]), actual.append(data[g][t])
        e = np.array(errors)
        assert (r.n, r.train_end) == (2 * (stop - end), end)
        assert np.allclose([r.mae, r.rmse, r.mape, r.bias], [abs(e).mean(), (e**2).mean() ** 0.5, abs(e / actual).mean(), e.mean()])


def test_trees_beat_the_mean_of_the_last_values(made):
    _, rows = made
    long = rows.where("g <> 'short'")
    by = {name: X.backtest(long, ["g"], fit, SPEC, [(50, 54)]).first().mae for name, fit in (("mean", X.moving_average(3)), ("boosted", X.trees("boosted", count=15, depth=3)))}
    assert by["boosted"] < by["mean"]


def test_scenarios(spark):
    i, o = (spark.createDataFrame([("a", 1, v)], "g string, step int, predicted double") for v in (100.0, 60.0))
    got = {r.scenario: (r.inflow, r.outflow, r.net, r.low, r.high) for r in X.scenarios(i, o, ["g"], 10.0, 2.0).collect()}
    assert got["base"] == (100, 60, 40, 20, 60)
    assert got["pessimistic"] == pytest.approx((85, 69, 16, 20, 60)) and got["optimistic"] == pytest.approx((115, 51, 64, 20, 60))
    assert X.scenarios(i.where(F.lit(False)), o, ["g"]).count() == 0
