"""Probability-scale explanations against Shapley values by their definition."""
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fraudlens.operators import sampling_explain as SX

W = [1.5, -2.0, 0.7, 0.0]
FEATURES = ["a", "b", "c", "d"]


def _by_definition(x, background, predict):
    m, phi = len(x), np.zeros(len(x))
    orders = list(permutations(range(m)))
    for order in orders:
        mixed, last = background.copy(), predict(background).mean()
        for j in order:
            mixed[:, j] = x[j]
            now = predict(mixed).mean()
            phi[j] += now - last
            last = now
    return phi / len(orders)


def _frame(spark, n=20):
    rng = np.random.default_rng(3)
    rows = [(i, *[float(v) for v in rng.normal(0, 1, 4)]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double")


def test_all_sets_give_the_exact_values(spark):
    df = _frame(spark)
    predict = SX.logistic(-0.4, W)
    bg = SX.background_matrix(df, FEATURES, "id", 7)
    assert bg.shape == (7, 4)
    out = SX.explain(df, FEATURES, predict, bg, 4, "id").collect()
    rows = {r["id"]: np.array([r[f] for f in FEATURES]) for r in df.collect()}
    assert len(out) == 80
    for i, x in rows.items():
        want = _by_definition(x, bg, predict)
        mine = {r["feature"]: r for r in out if r["id"] == i}
        assert np.allclose([mine[f]["shap_value"] for f in FEATURES], want, atol=1e-9)
        one = mine["a"]
        assert one["base_value"] + one["shap_sum"] == pytest.approx(one["predicted_probability"])
        ranked = sorted(mine.values(), key=lambda r: r["rank"])
        assert [abs(r["shap_value"]) for r in ranked] == sorted(
            (abs(r["shap_value"]) for r in ranked), reverse=True)


def test_drawn_sets_are_close_and_add_up():
    """14 features, 16,382 sets: a sixteenth of them in pairs."""
    rng = np.random.default_rng(4)
    w = rng.normal(0, 0.6, 14)
    predict, bg, x = SX.logistic(0.1, w), rng.normal(0, 1, (9, 14)), rng.normal(0, 1, (5, 14))
    exact_z, exact_w = SX.coalitions(14, 2 ** 14)
    z, weights = SX.coalitions(14, 1024)
    assert len(exact_z) == 2 ** 14 - 2 and len(z) <= 1024
    exact, p, base = SX.shapley(x, bg, predict, exact_z, SX.fit_matrix(exact_z, exact_w))
    got, _, _ = SX.shapley(x, bg, predict, z, SX.fit_matrix(z, weights))
    assert np.allclose(got.sum(axis=1), p - base)
    assert np.abs(got - exact).max() < 0.02


def test_odd_inputs(spark):
    df = _frame(spark, 3).withColumn("a", F.when(F.col("id") == 1, F.col("a")))
    predict = SX.logistic(0.0, [1.0, 1.0])
    bg = SX.background_matrix(df, ["a", "absent"], "id")
    out = SX.explain(df, ["a", "absent"], predict, bg, 1, "id").collect()
    assert len(out) == 3 and all(r["feature"] == "a" for r in out)
    assert SX.explain(df.limit(0), ["a"], SX.logistic(0.0, [1.0]), bg[:, :1], 1, "id").count() == 0
    with pytest.raises(ValueError):
        SX.explain(df, ["a"], SX.logistic(0.0, [1.0]), bg[:0, :1], 1, "id")
