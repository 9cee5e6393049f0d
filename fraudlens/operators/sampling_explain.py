"""Model-agnostic additive explanations on the probability scale.

For scorers without tree paths: the value of a set of features is the scorer's
mean probability over a background table when the row's values of that set
replace the background's. Shapley values are the weighted least squares fit of
these values with the sum fixed to (probability - base), weights by the Shapley
kernel. Up to ``max_coalitions`` sets all are taken and the values are exact;
beyond, sets are drawn in complementary pairs from the kernel's distribution of
sizes with a fixed seed. The sets are the same for every row, so the fit is one
small matrix applied to a row's values; rows are scored in Arrow batches.

The background is a bounded sample by definition (``BACKGROUND`` rows, those
whose ids hash least); every row given is explained.
"""
from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudlens.operators.explain import DECREASES, INCREASES
from fraudlens.session import dealt

BACKGROUND = 100
MAX_COALITIONS = 2048
CHUNK = 64                      # rows scored at once
LEAST_ROWS, MOST_ROWS = 500, 50_000      # rows of a task
Predict = Callable[[np.ndarray], np.ndarray]      # (n, features) -> n probabilities


def logistic(intercept: float, weights: list[float]) -> Predict:
    w = np.asarray(weights, dtype=float)

    def predict(x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):            # a margin far below 0 is probability 0
            return 1.0 / (1.0 + np.exp(-(intercept + x @ w)))
    predict.linear = (intercept, w)
    return predict


def scorecard_predict(card: dict) -> tuple[list[str], Predict]:
    """Features and scorer of a pinned scorecard."""
    return list(card["coefficients"]), logistic(float(card["intercept"]),
                                                list(card["coefficients"].values()))


def logistic_model_predict(model) -> Predict:
    """Scorer of the fitted logistic candidate: a standardising step and a
    logistic regression; a feature of one value has weight 0."""
    scaler, lr = model.stages
    mean, std = scaler.mean.toArray(), scaler.std.toArray()
    w = np.divide(lr.coefficients.toArray(), std, out=np.zeros(len(std)), where=std > 0)
    return logistic(float(lr.intercept - w @ mean), list(w))


def coalitions(m: int, max_coalitions: int = MAX_COALITIONS, seed: int = 42
               ) -> tuple[np.ndarray, np.ndarray]:
    """(sets x features 0/1, weights): all proper non-empty sets if they are few
    enough, else drawn pairs."""
    sizes = np.arange(1, m)
    if m <= 1:
        return np.zeros((0, m)), np.zeros(0)
    if 2 ** m - 2 <= max_coalitions:
        rows = [c for s in sizes for c in combinations(range(m), int(s))]
        z = np.zeros((len(rows), m))
        for n, c in enumerate(rows):
            z[n, list(c)] = 1.0
        k = z.sum(axis=1).astype(int)
        return z, np.array([(m - 1) / (math.comb(m, s) * s * (m - s)) for s in k])
    rng = np.random.default_rng(seed)
    p = 1.0 / (sizes * (m - sizes))
    drawn = {}
    for s in rng.choice(sizes, size=max_coalitions // 2, p=p / p.sum()):
        one = np.zeros(m)
        one[rng.choice(m, size=int(s), replace=False)] = 1.0
        for z in (one, 1.0 - one):
            drawn[z.tobytes()] = drawn.get(z.tobytes(), 0) + 1
    return (np.array([np.frombuffer(b) for b in drawn]), np.array(list(drawn.values()), dtype=float))


def fit_matrix(z: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A with phi[:-1] = A @ (values - z[:, -1] * total): the last feature's
    value is what the others leave of the total."""
    x = z[:, :-1] - z[:, -1:]
    xw = x * weights[:, None]
    return np.linalg.pinv(x.T @ xw) @ xw.T


def background_matrix(df: DataFrame, features: list[str], id_col: str, size: int = BACKGROUND
                      ) -> np.ndarray:
    rows = (df.select(id_col, *[_value(df, f).alias(f"f{i}") for i, f in enumerate(features)])
              .orderBy(F.xxhash64(id_col), id_col).limit(size).drop(id_col).collect())
    return np.array([list(r) for r in rows], dtype=float).reshape(-1, len(features))


def _value(df: DataFrame, f: str) -> F.Column:
    return F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in df.columns else F.lit(0.0)


def shapley(x: np.ndarray, background: np.ndarray, predict: Predict, z: np.ndarray,
            a: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(values per row and feature, probabilities, base) of some rows."""
    p, base, m = predict(x), float(predict(background).mean()), x.shape[1]
    if m == 1:
        return (p - base)[:, None], p, base
    v = np.empty((len(x), len(z)))
    if hasattr(predict, "linear"):      # a mixed row's margin is the sum of its two sides'
        intercept, w = predict.linear
        own, other = (x * w) @ z.T, (background * w) @ (1.0 - z).T
        with np.errstate(over="ignore"):
            for n in range(len(x)):
                v[n] = (1.0 / (1.0 + np.exp(-(intercept + own[n] + other)))).mean(axis=0)
    else:
        for n, s in enumerate(z):
            mixed = x[:, None, :] * s + background[None, :, :] * (1.0 - s)
            v[:, n] = predict(mixed.reshape(-1, m)).reshape(len(x), -1).mean(axis=1)
    total = p - base
    head = (v - base - total[:, None] * z[:, -1]) @ a.T
    return np.column_stack([head, total - head.sum(axis=1)]), p, base


def explain(df: DataFrame, features: list[str], predict: Predict, background: np.ndarray,
            top_n: int = 10, id_col: str = "TransactionID",
            max_coalitions: int = MAX_COALITIONS, seed: int = 42) -> DataFrame:
    """One row per (row, rank) for the ``top_n`` features by absolute value:
    feature, value, shap_value, direction, base_value, shap_sum (over all
    features), predicted_probability. Nulls and absent features count as 0; an
    empty background is refused."""
    if not len(background):
        raise ValueError("an explanation needs at least one background row")
    z, weights = coalitions(len(features), max_coalitions, seed)
    a, names = (fit_matrix(z, weights) if len(z) else np.zeros((0, 0))), np.array(features)

    def fn(parts):
        for part in parts:
            for at in range(0, len(part), CHUNK):
                rows = part.iloc[at:at + CHUNK]
                x = np.stack(rows["_x"].to_numpy()).astype(float)
                phi, p, base = shapley(x, background, predict, z, a)
                top = np.argsort(-np.abs(phi), axis=1, kind="stable")[:, :top_n]
                n, k = top.shape
                i = np.repeat(np.arange(n), k)
                f = top.ravel()
                yield pd.DataFrame({
                    "_id": rows["_id"].to_numpy()[i], "rank": np.tile(np.arange(1, k + 1), n),
                    "feature": names[f], "value": x[i, f], "shap_value": phi[i, f],
                    "base_value": base, "shap_sum": phi.sum(axis=1)[i],
                    "predicted_probability": p[i]})
    id_type = df.schema[id_col].dataType.simpleString()
    given = df.select(F.col(id_col).alias("_id"), F.array(*[_value(df, f) for f in features]).alias("_x"))
    out = dealt(given, LEAST_ROWS, MOST_ROWS) \
        .mapInPandas(fn, f"_id {id_type}, rank int, feature string, value double, shap_value double, "
                         "base_value double, shap_sum double, predicted_probability double")
    return out.withColumnRenamed("_id", id_col).withColumn(
        "direction", F.when(F.col("shap_value") > 0, F.lit(INCREASES)).otherwise(F.lit(DECREASES)))
