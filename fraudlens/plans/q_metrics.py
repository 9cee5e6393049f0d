"""Queries for model evaluation and the ML feature steps (M01-M03, M06,
M08-M11, M14, M16-M20, M25, A17, K08)."""
from __future__ import annotations

from pyspark.sql import functions as F

from fraudlens.functions import features as fx
from fraudlens.operators import aggregations as A
from fraudlens.operators import decisions as D
from fraudlens.operators import metrics as M
from fraudlens.operators import pipeline as P
from fraudlens.operators import rank as RK
from fraudlens.operators import windows as W
from fraudlens.plans import sql as S
from fraudlens.plans import sql_rules as SR
from fraudlens.plans.q_features import r6
from fraudlens.plans.registry import query
from fraudlens.sources import views as V

ORDER_CARD = dict(D.SCORECARD, coefficients={k: v for k, v in D.SCORECARD["coefficients"].items()
                                             if k != "P_email_suspicious"})
# Two one-feature comparison scorers for the model table.
AMOUNT_CARD = {"intercept": -12.0, "coefficients": {"log_amount": 1.0}}
ZSCORE_CARD = {"intercept": 0.0, "coefficients": {"card_amt_zscore": 1.0}}


def scored_orders(spark, sf):
    """txn_orders -> features -> pinned scorecards: TransactionID, TransactionDT,
    version (order year), y, p, p_amount, p_zscore."""
    f = W.sequence_features(A.with_card_aggregations(P.row_features(V.txn_orders(spark, sf)),
                                                     median="none"))
    f = D.scorecard_score(f, ORDER_CARD, "p")
    f = D.scorecard_score(f, AMOUNT_CARD, "p_amount")
    f = D.scorecard_score(f, ZSCORE_CARD, "p_zscore")
    version = F.year(F.timestamp_seconds(F.lit(V.ORDERS_EPOCH) + F.col("TransactionDT")))
    return f.select("TransactionID", "TransactionDT", version.alias("version"),
                    F.col("isFraud").alias("y"), "p", "p_amount", "p_zscore")


SCORED = S.with_ctes(
    S.TXN_ORDERS, S.ORDERS_FEATURES, S.card_stats_sql("ord_feat", "or_cs"),
    S.sequence_sql("or_cs", "or_seq"),
    f"""scored AS (
  SELECT TransactionID, TransactionDT,
         CAST(year(epoch_ms(({V.ORDERS_EPOCH}::BIGINT + TransactionDT) * 1000)) AS INTEGER)
           AS version,
         isFraud AS y, {SR.scorecard_sql(ORDER_CARD)} AS p,
         {SR.scorecard_sql(AMOUNT_CARD)} AS p_amount, {SR.scorecard_sql(ZSCORE_CARD)} AS p_zscore
  FROM or_seq)""")


def _cum_sql(p: str = "p", keys: str = "") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    kc = f"{keys}, " if keys else ""
    return f""",
g AS (SELECT {kc}{p} AS p, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY {kc}{p}),
c AS (SELECT *,
        coalesce(sum(pos) OVER ({part}ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
          AS pos_before,
        coalesce(sum(neg) OVER ({part}ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
          AS neg_before,
        sum(pos) OVER ({part.strip()}) AS n_pos, sum(neg) OVER ({part.strip()}) AS n_neg
      FROM g),
cc AS (SELECT *, n_pos - pos_before AS tp, n_neg - neg_before AS fp FROM c)"""


AUC_EXPR = 'sum(2 * pos * neg_before + pos * neg) / (2.0 * max(n_pos) * max(n_neg))'
AP_EXPR = 'sum(pos * tp / (tp + fp)) / max(n_pos)'


@query("m08_roc_auc", SCORED + _cum_sql() + f"""
SELECT round({AUC_EXPR}, 6) AS roc_auc FROM cc""")
def m08_roc_auc(spark, sf):
    return M.roc_auc(scored_orders(spark, sf)).select(r6(F.col("roc_auc")).alias("roc_auc"))


@query("m09_pr_auc", SCORED + _cum_sql() + f"""
SELECT round({AP_EXPR}, 6) AS pr_auc FROM cc""")
def m09_pr_auc(spark, sf):
    return M.average_precision(scored_orders(spark, sf)).select(r6(F.col("pr_auc"))
                                                                .alias("pr_auc"))


def _f1_sql(p: str = "p", tag: str = "", key: str | None = None) -> str:
    """CTEs that end in ``f1row<tag>``: one row, or one per ``key``."""
    vals = ", ".join(f"({i}, {t!r})" for i, t in enumerate(M.F1_THRESHOLDS))
    k, by = (f"{key}, ", f"PARTITION BY {key} ") if key else ("", "")
    return f""",
th{tag} AS (SELECT * FROM (VALUES {vals}) t(i, thr)),
m{tag} AS (SELECT {k}i, thr,
             sum(CASE WHEN {p} >= thr AND y = 1 THEN 1 ELSE 0 END) AS tp,
             sum(CASE WHEN {p} >= thr AND y = 0 THEN 1 ELSE 0 END) AS fp, sum(y) AS n_pos
      FROM th{tag}, scored GROUP BY {k}i, thr),
f{tag} AS (SELECT *, CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + (n_pos - tp)) ELSE 0.0 END AS f1,
             CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS prec,
             CASE WHEN n_pos > 0 THEN tp / n_pos ELSE 0.0 END AS rec FROM m{tag}),
r{tag} AS (SELECT *, row_number() OVER ({by}ORDER BY f1 DESC,
             CASE WHEN f1 > 0 THEN i WHEN thr = {M.DEFAULT_F1_THRESHOLD!r} THEN -1 ELSE i END) AS r
      FROM f{tag}),
f1row{tag} AS (
  SELECT {k}f1, prec AS precision, rec AS recall, thr AS optimal_threshold FROM r{tag} WHERE r = 1)"""


@query("m10_f1_optimal_threshold", SCORED + _f1_sql() + """
SELECT round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall,
       optimal_threshold FROM f1row""")
def m10_f1_optimal_threshold(spark, sf):
    r = M.f1_optimal(scored_orders(spark, sf))
    return r.select(*[r6(F.col(c)).alias(c) for c in ("f1", "precision", "recall")],
                    "optimal_threshold")


def _models_sql() -> str:
    parts = []
    for name, col in (("scorecard", "p"), ("amount_only", "p_amount"), ("zscore_only", "p_zscore")):
        parts.append(f"""
SELECT '{name}' AS model,
       (SELECT round({AUC_EXPR}, 6) FROM cc_{col}) AS roc_auc,
       (SELECT round({AP_EXPR}, 6) FROM cc_{col}) AS pr_auc,
       round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall
FROM f1row_{col}""")
    ctes = []
    for col in ("p", "p_amount", "p_zscore"):
        c = _cum_sql(col).replace("g AS (", f"g_{col} AS (").replace("FROM g)", f"FROM g_{col})") \
                          .replace("c AS (", f"c_{col} AS (").replace("FROM c)", f"FROM c_{col})") \
                          .replace("cc AS (", f"cc_{col} AS (")
        ctes.append(c + _f1_sql(col, f"_{col}"))
    return SCORED + "".join(ctes) + "\nSELECT * FROM (" + " UNION ALL ".join(parts) + ")"


MODELS = {"scorecard": "p", "amount_only": "p_amount", "zscore_only": "p_zscore"}


@query("a17_model_comparison", _models_sql())
def a17_model_comparison(spark, sf):
    s = scored_orders(spark, sf)
    long = M.metrics_long(s, MODELS)
    piv = A.pivot_metrics(long.where(F.col("metric").isin(*M.METRIC_NAMES)))
    return piv.select("model", *[r6(F.col(m)).alias(m) for m in M.METRIC_NAMES])


@query("m11_best_model", "SELECT model AS best_model, pr_auc FROM (" +
       _models_sql().replace("\nSELECT * FROM (", "\nSELECT * FROM (SELECT * FROM (", 1) +
       ") ORDER BY pr_auc DESC LIMIT 1)")
def m11_best_model(spark, sf):
    s = scored_orders(spark, sf)
    long = M.metrics_long(s, MODELS).withColumn("value", r6(F.col("value")))
    return M.best_model(long)


@query("m14_binary_prediction", SCORED + f"""
SELECT TransactionID, CAST(p >= {float(ORDER_CARD['threshold'])!r} AS INTEGER) AS prediction
FROM scored""")
def m14_binary_prediction(spark, sf):
    s = scored_orders(spark, sf)
    return s.select("TransactionID",
                    D.predict_label(F.col("p"), ORDER_CARD["threshold"]).alias("prediction"))


@query("m15_scorecard_probability", SCORED + """
SELECT TransactionID, p AS fraud_score FROM scored""")
def m15_scorecard_probability(spark, sf):
    return scored_orders(spark, sf).select("TransactionID", F.col("p").alias("fraud_score"))


@query("m16_roc_points", SCORED + _cum_sql() + """
SELECT p AS threshold, round(fp / n_neg, 6) AS fpr, round(tp / n_pos, 6) AS tpr FROM cc""")
def m16_roc_points(spark, sf):
    r = M.roc_points(scored_orders(spark, sf))
    return r.select("threshold", r6(F.col("fpr")).alias("fpr"), r6(F.col("tpr")).alias("tpr"))


@query("m17_pr_points", SCORED + _cum_sql() + """
SELECT p AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / n_pos, 6) AS recall,
       round(n_pos / (n_pos + n_neg), 6) AS base_rate FROM cc""")
def m17_pr_points(spark, sf):
    r = M.pr_points(scored_orders(spark, sf))
    return r.select("threshold", *[r6(F.col(c)).alias(c)
                                   for c in ("precision", "recall", "base_rate")])


@query("m18_confusion_matrix", SCORED + """
SELECT CAST(y AS INTEGER) AS actual, CAST(p >= 0.5 AS INTEGER) AS predicted, count(*) AS n
FROM scored GROUP BY 1, 2""")
def m18_confusion_matrix(spark, sf):
    return M.confusion(scored_orders(spark, sf), 0.5)


def _calib_sql() -> str:
    b = " + ".join(f"CAST(p > {e!r} AS INTEGER)" for e in M.CALIBRATION_EDGES[1:-1])
    return SCORED + f"""
SELECT {b} AS bin, round(avg(CAST(y AS DOUBLE)), 6) AS prob_true, round(avg(p), 6) AS prob_pred,
       count(*) AS n
FROM scored GROUP BY 1"""


@query("m19_calibration", _calib_sql())
def m19_calibration(spark, sf):
    c = M.calibration(scored_orders(spark, sf))
    return c.select("bin", r6(F.col("prob_true")).alias("prob_true"),
                    r6(F.col("prob_pred")).alias("prob_pred"), "n")


def _density_sql() -> str:
    e = M.DENSITY_EDGES
    cnt = " + ".join(f"CAST(p >= {x!r} AS INTEGER)" for x in e)
    arr = "[" + ", ".join(repr(x) for x in e) + "]"
    return SCORED + f""",
b AS (SELECT CAST(y AS INTEGER) AS label, least({cnt} - 1, {len(e) - 2}) AS bin
      FROM scored WHERE p >= 0 AND p <= 1),
k AS (SELECT label, bin, count(*) AS n FROM b GROUP BY 1, 2)
SELECT label, CAST(bin AS INTEGER) AS bin, n,
       round(n / (sum(n) OVER (PARTITION BY label) * ({arr}[bin + 2] - {arr}[bin + 1])), 6) AS density
FROM k"""


@query("m20_score_density", _density_sql())
def m20_score_density(spark, sf):
    d = M.score_density(scored_orders(spark, sf))
    return d.select("label", "bin", "n", r6(F.col("density")).alias("density"))


@query("m06_class_weights", SCORED + f"""
SELECT CAST(y AS INTEGER) AS label, count(*) AS n,
       round(sum(count(*)) OVER () / (2.0 * count(*)), 6) AS balanced_weight,
       CASE WHEN y = 1 THEN {M.POSITIVE_CLASS_WEIGHT!r} ELSE 1.0 END AS fixed_weight
FROM scored GROUP BY y""")
def m06_class_weights(spark, sf):
    w = M.class_weights(scored_orders(spark, sf))
    return w.select("label", "n", r6(F.col("balanced_weight")).alias("balanced_weight"),
                    "fixed_weight")


_HISTORY = SCORED + _cum_sql(keys="version") + _f1_sql(key="version") + f""",
h AS (SELECT a.*, f.f1, f.precision, f.recall, f.optimal_threshold
      FROM (SELECT version, {AUC_EXPR} AS roc_auc, {AP_EXPR} AS pr_auc FROM cc GROUP BY version) a
      JOIN f1row f USING (version))"""
SIX_METRICS = (*M.METRIC_NAMES, "optimal_threshold")


@query("m25_metric_history", _HISTORY + """
SELECT version, """ + ", ".join(f"round({m}, 6) AS {m}" for m in SIX_METRICS) + """,
       round(roc_auc - lag(roc_auc) OVER (ORDER BY version), 6) AS roc_auc_delta,
       round(pr_auc - lag(pr_auc) OVER (ORDER BY version), 6) AS pr_auc_delta
FROM h""")
def m25_metric_history(spark, sf):
    h = M.metric_history(scored_orders(spark, sf), "version")
    return h.select("version", *[r6(F.col(c)).alias(c) for c in
                                 (*SIX_METRICS, "roc_auc_delta", "pr_auc_delta")])


# M01 / M02 ------------------------------------------------------------------
M01_COLS = ["ProductCD", "P_emaildomain", "R_emaildomain"]


@query("m01_category_codes", S.with_ctes(S.TXN_EVENTS) + """,
v AS (SELECT DISTINCT 'ProductCD' AS "column", coalesce(ProductCD, 'nan') AS value FROM txn_events
      UNION SELECT DISTINCT 'P_emaildomain', coalesce(P_emaildomain, 'nan') FROM txn_events
      UNION SELECT DISTINCT 'R_emaildomain', coalesce(R_emaildomain, 'nan') FROM txn_events)
SELECT "column", value, CAST(row_number() OVER (PARTITION BY "column" ORDER BY value) - 1 AS INTEGER)
         AS code
FROM v""")
def m01_category_codes(spark, sf):
    return P.fit_category_codes(V.txn_events(spark, sf), M01_COLS)


@query("m01_encoded_events", S.with_ctes(S.TXN_EVENTS) + """,
v AS (SELECT DISTINCT coalesce(R_emaildomain, 'nan') AS value FROM txn_events),
c AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS code FROM v)
SELECT t.TransactionID, c.code AS R_emaildomain
FROM txn_events t LEFT JOIN c ON coalesce(t.R_emaildomain, 'nan') = c.value""")
def m01_encoded_events(spark, sf):
    t = V.txn_events(spark, sf)
    codes = P.fit_category_codes(t, ["R_emaildomain"])
    return P.apply_category_codes(t, codes, ["R_emaildomain"]).select("TransactionID",
                                                                     "R_emaildomain")


@query("m02_median_fill", S.with_ctes(S.TXN_EVENTS, S.IDENTITY) + """,
mg AS (SELECT t.TransactionID, i.id_01, i.id_02 FROM txn_events t
       LEFT JOIN identity i ON t.TransactionID = i.TransactionID)
SELECT TransactionID, coalesce(id_01, (SELECT median(id_01) FROM mg)) AS id_01,
       coalesce(id_02, (SELECT median(id_02) FROM mg)) AS id_02
FROM mg""")
def m02_median_fill(spark, sf):
    m = P.merge_identity(V.txn_events(spark, sf), V.identity(spark, sf)) \
         .select("TransactionID", "id_01", "id_02")
    return P.fill_medians(m, P.fit_medians(m, ["id_01", "id_02"]))


@query("m02_sketch_median_rank", S.with_ctes(S.TXN_EVENTS) + """
SELECT unnest(['TransactionAmt', 'TransactionDT']) AS "column", count(*) AS n, true AS near_middle
FROM txn_events""")
def m02_sketch_median_rank(spark, sf):
    """Whether medians of merged daily sketches lie within 1 % of the middle
    rank of all rows."""
    t = V.txn_events(spark, sf).select("TransactionAmt", "TransactionDT")
    cols = ["TransactionAmt", "TransactionDT"]
    med = P.sketch_medians(P.median_sketches(t, cols, F.floor(F.col("TransactionDT") / 86400)))
    parts = [t.agg(F.lit(c).alias("column"), F.count(c).alias("n"),
                   F.avg((F.col(c) < med[c]).cast("double")).alias("below"),
                   F.avg((F.col(c) <= med[c]).cast("double")).alias("upto")) for c in cols]
    return parts[0].unionByName(parts[1]).select(
        "column", "n", ((F.col("below") <= 0.51) & (F.col("upto") >= 0.49)).alias("near_middle"))


_M03_DOUBLES = ["hour_sin", "hour_cos", "dow_sin", "dow_cos", "log_amount", "card1_card_amt_mean",
                "card1_card_amt_std", "card1_card_amt_min", "card1_card_amt_max",
                "card1_card_amt_median", "card_amt_zscore", "card_amt_vs_max", "TransactionAmt"]


@query("m03_feature_matrix", S.with_ctes(
    S.TXN_EVENTS, S.IDENTITY, S.EVENTS_FEATURES, S.card_stats_sql("ev_feat", "cs"),
    S.sequence_sql("cs", "sq")) + """,
prod AS (SELECT ProductCD AS p, count(TransactionAmt) AS prod_txn_count,
                avg(TransactionAmt) AS prod_amt_mean, avg(isFraud) AS prod_fraud_rate
         FROM ev_feat GROUP BY ProductCD),
j AS (SELECT sq.*, i.id_01, i.id_02, prod.* FROM sq LEFT JOIN identity i USING (TransactionID)
      LEFT JOIN prod ON prod.p = sq.ProductCD)
SELECT TransactionID, isFraud, card1, TransactionDT, C1, failed,
       CAST(dense_rank() OVER (ORDER BY coalesce(ProductCD, 'nan')) - 1 AS INTEGER) AS ProductCD,
       CAST(dense_rank() OVER (ORDER BY coalesce(P_emaildomain, 'nan')) - 1 AS INTEGER) AS P_emaildomain,
       CAST(dense_rank() OVER (ORDER BY coalesce(R_emaildomain, 'nan')) - 1 AS INTEGER) AS R_emaildomain,
       round(coalesce(id_01, (SELECT median(id_01) FROM j)) + 1e-9, 6) AS id_01,
       round(coalesce(id_02, (SELECT median(id_02) FROM j)) + 1e-9, 6) AS id_02,
       hour, day_of_week, day_of_month, month, is_weekend, is_night, amount_cents,
       is_round_amount, amount_digits, P_email_suspicious, P_email_same_as_R, R_email_suspicious,
       R_email_same_as_R, card1_card_txn_count, prod_txn_count,
       round(prod_amt_mean + 1e-9, 6) AS prod_amt_mean, round(prod_fraud_rate + 1e-9, 6) AS prod_fraud_rate,
       card_txn_rank, time_since_last_txn, rapid_succession,
       """ + ", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in _M03_DOUBLES) + """
FROM j""")
def m03_feature_matrix(spark, sf):
    """Training-mode feature matrix of the event transactions (+ identity).
    Values are moved by 1e-9 before rounding: a mean of cents can end in an
    exact half, which the order of a sum would round either way."""
    df = P.merge_identity(V.txn_events(spark, sf), V.identity(spark, sf))
    X, _ = P.build_feature_matrix(df)
    return X.select(*[r6(F.col(c) + 1e-9).alias(c) if t == "double" else F.col(c) for c, t in X.dtypes])


# K08 ------------------------------------------------------------------------
@query("k08_time_split", S.with_ctes(S.TXN_ORDERS) + """
SELECT TransactionID,
       CASE WHEN row_number() OVER (ORDER BY TransactionDT, TransactionID)
                 <= (SELECT CAST(floor(count(*) * (1 - 0.2)) AS BIGINT) FROM txn_orders)
            THEN 'train' ELSE 'validation' END AS split
FROM txn_orders""")
def k08_time_split(spark, sf):
    t = V.txn_orders(spark, sf).select("TransactionID", "TransactionDT")
    tr, va = RK.time_split(t, 0.2)
    return tr.select("TransactionID", F.lit("train").alias("split")).unionByName(
        va.select("TransactionID", F.lit("validation").alias("split")))


@query("x01_global_index", S.with_ctes(S.TXN_EVENTS) + """
SELECT TransactionID, row_number() OVER (ORDER BY TransactionDT, TransactionID) - 1 AS idx
FROM txn_events""")
def x01_global_index(spark, sf):
    t = V.txn_events(spark, sf).select("TransactionID", "TransactionDT")
    return RK.global_index(t, "TransactionDT", "TransactionID", "idx").select("TransactionID",
                                                                              "idx")


# K04 ------------------------------------------------------------------------
K04_VERSION = 1998


@query("k04_model_metrics", _HISTORY + """
SELECT version, metric, round(value, 6) AS value FROM (""" + " UNION ALL ".join(
    f"SELECT version, '{m}' AS metric, {m} AS value FROM h" for m in SIX_METRICS) + f""")
WHERE version = {K04_VERSION} ORDER BY metric""")
def k04_model_metrics(spark, sf):
    """Stored metrics of one model version (the per-version history, M25)."""
    h = M.metric_history(scored_orders(spark, sf), "version")
    long = h.select("version", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in SIX_METRICS])).alias("m"))
    return (long.where(F.col("version") == K04_VERSION)
                .select("version", "m.metric", r6(F.col("m.value")).alias("value"))
                .orderBy("metric"))
