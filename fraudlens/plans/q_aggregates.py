"""Queries for aggregations and statistic joins."""
from __future__ import annotations

from pyspark.sql import functions as F

from fraudlens.operators import aggregations as A
from fraudlens.plans import sql as S
from fraudlens.plans.q_features import ev_feat, ord_feat, r6
from fraudlens.plans.registry import query
from fraudlens.sources import views as V


def _r6_all(df, keep=()):
    return df.select(*[r6(F.col(c)).alias(c) if t == "double" and c not in keep else F.col(c)
                       for c, t in df.dtypes])


ORD = S.with_ctes(S.TXN_ORDERS)
EVT = S.with_ctes(S.TXN_EVENTS)


@query("a01_card_stats", ORD + """
SELECT card1, count(TransactionAmt) AS card1_card_txn_count,
       round(avg(TransactionAmt), 6) AS card1_card_amt_mean,
       round(stddev_samp(TransactionAmt), 6) AS card1_card_amt_std,
       round(min(TransactionAmt), 6) AS card1_card_amt_min,
       round(max(TransactionAmt), 6) AS card1_card_amt_max,
       round(median(TransactionAmt), 6) AS card1_card_amt_median
FROM txn_orders WHERE card1 IS NOT NULL GROUP BY card1""")
def a01_card_stats(spark, sf):
    return _r6_all(A.card_stats(V.txn_orders(spark, sf)))


@query("a02_card_zscore", S.with_ctes(S.TXN_ORDERS, S.card_stats_sql("txn_orders", "ord_cs"))
       + """
SELECT TransactionID, round(card1_card_amt_std, 6) AS card1_card_amt_std,
       round(card_amt_zscore, 6) AS card_amt_zscore, round(card_amt_vs_max, 6) AS card_amt_vs_max
FROM ord_cs""")
def a02_card_zscore(spark, sf):
    j = A.with_card_aggregations(V.txn_orders(spark, sf), median="none")
    return _r6_all(j.select("TransactionID", "card1_card_amt_std", "card_amt_zscore",
                            "card_amt_vs_max"))


@query("j02_card_stats_join", S.with_ctes(S.TXN_ORDERS, S.card_stats_sql("txn_orders", "ord_cs"))
       + """
SELECT TransactionID, card1, card1_card_txn_count, round(card1_card_amt_mean, 6) AS card1_card_amt_mean,
       round(card1_card_amt_median, 6) AS card1_card_amt_median
FROM ord_cs""")
def j02_card_stats_join(spark, sf):
    j = A.with_card_aggregations(V.txn_orders(spark, sf))
    return _r6_all(j.select("TransactionID", "card1", "card1_card_txn_count",
                            "card1_card_amt_mean", "card1_card_amt_median"))


PROD_SQL = """
SELECT ProductCD, count(TransactionAmt) AS prod_txn_count,
       round(avg(TransactionAmt), 6) AS prod_amt_mean,
       round(avg(isFraud), 6) AS prod_fraud_rate
FROM txn_events WHERE ProductCD IS NOT NULL GROUP BY ProductCD"""


@query("a03_product_stats", EVT + PROD_SQL)
def a03_product_stats(spark, sf):
    return _r6_all(A.product_stats(V.txn_events(spark, sf)))


@query("j03_product_stats_join", EVT + f""",
ps AS ({PROD_SQL})
SELECT t.TransactionID, t.ProductCD, ps.prod_txn_count, ps.prod_amt_mean, ps.prod_fraud_rate
FROM txn_events t LEFT JOIN ps ON t.ProductCD = ps.ProductCD""")
def j03_product_stats_join(spark, sf):
    t = V.txn_events(spark, sf)
    j = A.with_product_aggregations(t, stats=_r6_all(A.product_stats(t)))
    return j.select("TransactionID", "ProductCD", "prod_txn_count", "prod_amt_mean",
                    "prod_fraud_rate")


@query("a04_fraud_rate", EVT + """
SELECT count(*) AS n_rows, CAST(sum(isFraud) AS BIGINT) AS n_fraud,
       round(avg(isFraud), 6) AS fraud_rate FROM txn_events""")
def a04_fraud_rate(spark, sf):
    return _r6_all(A.fraud_rate(V.txn_events(spark, sf)))


_A05_COLS = ["TransactionID", "TransactionDT", "TransactionAmt", "ProductCD", "card1", "C1",
             "failed", "P_emaildomain", "R_emaildomain", "isFraud", "id_01", "id_02",
             "DeviceType"]


def _a05_sql():
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(avg(CAST({c} IS NULL AS DOUBLE)), 6) "
        f"AS missing_fraction FROM merged" for c in _A05_COLS)
    return S.with_ctes(S.TXN_EVENTS, S.IDENTITY) + f""",
merged AS (SELECT t.*, i.id_01, i.id_02, i.DeviceType
           FROM txn_events t LEFT JOIN identity i ON t.TransactionID = i.TransactionID)
SELECT * FROM ({parts}) ORDER BY missing_fraction DESC, column_name LIMIT 20"""


@query("a05_missing_fraction", _a05_sql())
def a05_missing_fraction(spark, sf):
    from fraudlens.operators.pipeline import merge_identity
    m = merge_identity(V.txn_events(spark, sf), V.identity(spark, sf))
    return _r6_all(A.missing_fraction(m, 20))


@query("a06_class_counts", ORD + """
SELECT isFraud, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct
FROM txn_orders GROUP BY isFraud""")
def a06_class_counts(spark, sf):
    return _r6_all(A.class_counts(V.txn_orders(spark, sf)))


@query("a07_describe_by_class", ORD + """
SELECT isFraud, count(TransactionAmt) AS count, round(avg(TransactionAmt), 6) AS mean,
       round(stddev_samp(TransactionAmt), 6) AS std, round(min(TransactionAmt), 6) AS min,
       round(quantile_cont(TransactionAmt, 0.25), 6) AS p25,
       round(quantile_cont(TransactionAmt, 0.5), 6) AS p50,
       round(quantile_cont(TransactionAmt, 0.75), 6) AS p75,
       round(max(TransactionAmt), 6) AS max
FROM txn_orders GROUP BY isFraud""")
def a07_describe_by_class(spark, sf):
    return _r6_all(A.describe_by_class(V.txn_orders(spark, sf)))


@query("a08_box_summary", ORD + """,
q AS (SELECT isFraud, quantile_cont(TransactionAmt, 0.25) AS q1,
             quantile_cont(TransactionAmt, 0.5) AS median,
             quantile_cont(TransactionAmt, 0.75) AS q3
      FROM txn_orders GROUP BY isFraud)
SELECT t.isFraud, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(q3 - q1, 6) AS iqr,
       round(min(CASE WHEN TransactionAmt >= q1 - 1.5 * (q3 - q1) THEN TransactionAmt END), 6)
         AS whisker_low,
       round(max(CASE WHEN TransactionAmt <= q3 + 1.5 * (q3 - q1) THEN TransactionAmt END), 6)
         AS whisker_high,
       CAST(sum(CASE WHEN TransactionAmt < q1 - 1.5 * (q3 - q1)
                       OR TransactionAmt > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) AS BIGINT)
         AS n_outliers
FROM txn_orders t JOIN q ON t.isFraud = q.isFraud
GROUP BY t.isFraud, q1, median, q3""")
def a08_box_summary(spark, sf):
    return _r6_all(A.box_summary(V.txn_orders(spark, sf)))


def _hist_sql(value_sql: str, n: int, by: str | None) -> str:
    k = f"{by}, " if by else ""
    join = f"JOIN rng USING ({by})" if by else ", rng"
    grp = f"GROUP BY {by}" if by else ""
    return ORD + f""",
base AS (SELECT {k}{value_sql} AS v FROM txn_orders WHERE {value_sql} IS NOT NULL),
rng AS (SELECT {k}CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
               CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi
        FROM base {grp}),
b AS (SELECT {k}CAST(least(floor((v - lo) * {n} / (hi - lo)), {n - 1}) AS INTEGER) AS bin, lo, hi
      FROM base {join})
SELECT {k}bin, round(lo + bin * ((hi - lo) / {n}), 6) AS bin_lo,
       round(lo + (bin + 1) * ((hi - lo) / {n}), 6) AS bin_hi, count(*) AS n
FROM b GROUP BY {k}bin, lo, hi"""


@query("a09_hist_amount", _hist_sql("TransactionAmt", 100, None))
def a09_hist_amount(spark, sf):
    h = A.equal_width_histogram(V.txn_orders(spark, sf), "TransactionAmt", 100)
    return _r6_all(h)


@query("a09_hist_log_amount", _hist_sql("ln(1 + TransactionAmt)", 80, None))
def a09_hist_log_amount(spark, sf):
    h = A.equal_width_histogram(V.txn_orders(spark, sf), F.log1p("TransactionAmt"), 80)
    return _r6_all(h)


@query("a09_hist_by_class", _hist_sql("TransactionAmt", 50, "isFraud"))
def a09_hist_by_class(spark, sf):
    h = A.equal_width_histogram(V.txn_orders(spark, sf), "TransactionAmt", 50, by="isFraud")
    return _r6_all(h)


@query("a09_hist_log_amount_100", _hist_sql("ln(1 + TransactionAmt)", 100, None))
def a09_hist_log_amount_100(spark, sf):
    h = A.equal_width_histogram(V.txn_orders(spark, sf), F.log1p("TransactionAmt"), 100)
    return _r6_all(h)


@query("a09_hist_by_class_60", _hist_sql("TransactionAmt", 60, "isFraud"))
def a09_hist_by_class_60(spark, sf):
    h = A.equal_width_histogram(V.txn_orders(spark, sf), "TransactionAmt", 60, by="isFraud")
    return _r6_all(h)


EVF = S.with_ctes(S.TXN_EVENTS, S.EVENTS_FEATURES)
ORF = S.with_ctes(S.TXN_ORDERS, S.ORDERS_FEATURES)


def _rate_sql(src_ctes: str, src: str, key: str, name: str) -> str:
    return src_ctes + f"""
SELECT {key} AS {name}, count(*) AS n, CAST(sum(isFraud) AS BIGINT) AS n_fraud,
       round(avg(isFraud), 6) AS fraud_rate
FROM {src} GROUP BY 1"""


@query("a10_fraud_by_hour", _rate_sql(EVF, "ev_feat", "hour", "hour"))
def a10_fraud_by_hour(spark, sf):
    return _r6_all(A.rate_by(ev_feat(spark, sf), "hour"))


@query("a10_fraud_by_weekday", _rate_sql(EVF, "ev_feat", "day_of_week", "day_of_week"))
def a10_fraud_by_weekday(spark, sf):
    return _r6_all(A.rate_by(ev_feat(spark, sf), "day_of_week"))


@query("a10_fraud_by_night", _rate_sql(EVF, "ev_feat", "is_night", "is_night"))
def a10_fraud_by_night(spark, sf):
    return _r6_all(A.rate_by(ev_feat(spark, sf), "is_night"))


@query("a11_fraud_by_card4", _rate_sql(ORD, "txn_orders", "card4", "card4"))
def a11_fraud_by_card4(spark, sf):
    return _r6_all(A.rate_by(V.txn_orders(spark, sf), "card4")).orderBy(F.desc("fraud_rate"),
                                                                         "card4")


@query("a11_fraud_by_card6", _rate_sql(ORD, "txn_orders", "card6", "card6"))
def a11_fraud_by_card6(spark, sf):
    return _r6_all(A.rate_by(V.txn_orders(spark, sf), "card6")).orderBy(F.desc("fraud_rate"),
                                                                         "card6")


@query("a12_email_domains_top20", EVT + """
SELECT P_emaildomain, count(*) AS n, CAST(sum(isFraud) AS BIGINT) AS n_fraud,
       round(avg(isFraud), 6) AS fraud_rate
FROM txn_events GROUP BY 1 ORDER BY n DESC, P_emaildomain LIMIT 20""")
def a12_email_domains_top20(spark, sf):
    return _r6_all(A.top_by_count(V.txn_events(spark, sf), "P_emaildomain", 20))


# A16 / A18 ------------------------------------------------------------------
def _cum_hist_sql(ctes: str, src: str, value: str, bounds: list[float],
                  keys: tuple[str, ...] = ()) -> str:
    k = "".join(f"{x}, " for x in keys)
    grp = f"GROUP BY {', '.join(keys)}" if keys else ""
    cols = ", ".join(f"CAST(sum(CASE WHEN {value} <= {b!r} THEN 1 ELSE 0 END) AS BIGINT) AS b{i}"
                     for i, b in enumerate(bounds))
    arms = " UNION ALL ".join(
        f"SELECT {k}'{A._bound_label(b)}' AS le, {float(b)!r} AS le_value, b{i} AS cum_count, "
        f"count, sum FROM w" for i, b in enumerate(bounds))
    return ctes + f""",
w AS (SELECT {k}{cols}, count({value}) AS count, round(sum({value}), 6) AS sum FROM {src} {grp})
{arms}
UNION ALL SELECT {k}'+Inf', 'inf'::DOUBLE, count, count, sum FROM w"""


@query("a16_latency_histogram", _cum_hist_sql(S.with_ctes(S.REQUESTS), "requests", "latency_s",
                                              A.PREDICTION_LATENCY_BOUNDS))
def a16_latency_histogram(spark, sf):
    h = A.cumulative_histogram(V.requests(spark, sf), "latency_s", A.PREDICTION_LATENCY_BOUNDS)
    return h.withColumn("sum", r6(F.col("sum")))


@query("a18_request_counts", S.with_ctes(S.REQUESTS) + """
SELECT method, endpoint, status_code, count(*) AS n FROM requests GROUP BY 1, 2, 3""")
def a18_request_counts(spark, sf):
    return A.request_counts(V.requests(spark, sf))


@query("a18_request_latency_histogram",
       _cum_hist_sql(S.with_ctes(S.REQUESTS), "requests", "latency_s",
                     A.REQUEST_LATENCY_BOUNDS, ("method", "endpoint")))
def a18_request_latency_histogram(spark, sf):
    h = A.request_latency_histogram(V.requests(spark, sf))
    return h.withColumn("sum", r6(F.col("sum")))
