"""Model jobs at size: stored matrices, exact medians, tabled tree values."""
import statistics

import numpy as np
from pyspark.sql import functions as F

from fraudlens.operators import pipeline as P
from fraudlens.operators import prefix_search as PS
from fraudlens.operators import sampling_explain as SX
from fraudlens.operators import treeshap as TS


def test_medians_rank_only_the_middle_values(spark, monkeypatch):
    """Random, tied, null, NaN and constant columns against Python, and only
    values near the middle are ranked."""
    rng = np.random.default_rng(5)
    n = 4001
    rows = [(float(rng.normal()), int(rng.integers(0, 3)), None if i % 3 else float(i), 7.0,
             float("nan") if i % 2 else 1.0, None) for i in range(n)]
    df = spark.createDataFrame(rows, "a double, b int, c double, d double, e double, f double")
    ranked = []
    stacked = P._stacked
    monkeypatch.setattr(P, "_stacked", lambda v, d: ranked.append(stacked(v, d).count()) or stacked(v, d))
    got = P.fit_medians(df)
    assert set(got) == {"a", "b", "c", "d", "e"}
    for i, c in enumerate("abcd"):
        assert got[c] == statistics.median(r[i] for r in rows if r[i] is not None)
    assert got["e"] == df.select(F.expr("percentile(e, 0.5)")).first()[0]
    ranked.clear()
    P.fit_medians(df.drop("e"))
    assert sum(ranked) < n / 10
    even = df.where("c is not null").orderBy("c").limit(10)
    assert P.fit_medians(even)["c"] == 13.5


def _table(rng, depth, features, trees=3):
    """Full trees with random splits, as ``ensemble_table`` gives them."""
    def grow(level, path):
        if level == depth:
            return [(float(rng.random()), path)]
        f, thr, frac = int(rng.integers(0, features)), float(rng.normal()), float(rng.uniform(0.1, 0.9))
        return grow(level + 1, path + [(f, thr, True, frac)]) + grow(level + 1, path + [(f, thr, False, 1 - frac)])
    return {"trees": [grow(0, []) for _ in range(trees)], "weights": np.full(trees, 1 / trees),
            "kind": "classification", "link": "identity"}


def test_tabled_leaves_equal_leaves_by_row(monkeypatch):
    """Many rows share a leaf's sets; the values are those computed row by row,
    missing values included, and a leaf is worked out on its sets alone."""
    rng = np.random.default_rng(2)
    table, x = _table(rng, 5, 7), rng.normal(size=(3000, 7))
    x[::11, 3] = np.nan
    seen = []
    by_set = TS._leaf_values
    monkeypatch.setattr(TS, "_leaf_values", lambda o, z, v: seen.append(len(o)) or by_set(o, z, v))
    phi, base = TS.shap_values(table, x, 7)
    assert max(seen) <= 2 ** 5
    monkeypatch.setattr(TS, "TABLED", 0)
    plain, same = TS.shap_values(table, x, 7)
    assert base == same and np.allclose(phi, plain, rtol=0, atol=1e-12)
    assert np.allclose(base + phi.sum(axis=1), TS.predict_margin(table, x), atol=1e-9)


def test_linear_scorers_need_no_mixed_rows():
    """The values of a logistic scorer by margins equal those of mixed rows."""
    rng = np.random.default_rng(4)
    predict = SX.logistic(-0.3, list(rng.normal(size=6)))
    x, bg = rng.normal(size=(20, 6)), rng.normal(size=(9, 6))
    z, w = SX.coalitions(6)
    a, sizes = SX.fit_matrix(z, w), []

    def counted(rows):
        sizes.append(len(rows))
        return predict(rows)
    plain = SX.shapley(x, bg, counted, z, a)
    assert max(sizes) == 180
    sizes.clear()
    counted.linear = predict.linear
    fast = SX.shapley(x, bg, counted, z, a)
    assert sorted(sizes) == [9, 20]
    assert np.allclose(plain[0], fast[0], rtol=0, atol=1e-12) and plain[2] == fast[2]


def test_training_tasks_stay_small(spark, monkeypatch):
    """A task's share of the training rows does not grow with the table."""
    rows = spark.range(600_001).selectExpr("0.0 label", "1.0 weight", "id features")
    monkeypatch.setattr(PS, "LEAST_ROWS", 10_000_000)        # slots play no part
    dealt = PS.training_rows(rows)
    assert dealt.rdd.getNumPartitions() >= 3
    assert dealt.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 250_000
    dealt.unpersist()


def test_order_matrices_are_stored(spark):
    """What fits and scores read is a written table, not the feature plan."""
    from fraudlens.plans import q_ml
    tr, va, _ = q_ml.ml_frames(spark, "/root/testdata/sf0.001")
    for frame in (tr, va):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Join" not in plan
