"""Queries for scalar functions (F01-F15), validation (V01-V07) and J01."""
from __future__ import annotations

from pyspark.sql import functions as F

from fraudlens.functions import features as fx
from fraudlens.operators import pipeline as P
from fraudlens.operators import rules as R
from fraudlens.operators import validation as VAL
from fraudlens.plans import sql as S
from fraudlens.plans.registry import query
from fraudlens.sources import views as V


def r6(c):
    return F.round(c, 6)


def ev_feat(spark, sf):
    return P.row_features(V.txn_events(spark, sf))


def ord_feat(spark, sf):
    return P.row_features(V.txn_orders(spark, sf))


EVW = S.with_ctes(S.TXN_EVENTS, S.EVENTS_FEATURES)
ORW = S.with_ctes(S.TXN_ORDERS, S.ORDERS_FEATURES)


@query("f01_time_parts", EVW + """
SELECT TransactionID, hour, day_of_week, day_of_month, month FROM ev_feat""")
def f01_time_parts(spark, sf):
    return ev_feat(spark, sf).select("TransactionID", "hour", "day_of_week", "day_of_month",
                                     "month")


@query("f02_weekend_night", EVW + """
SELECT TransactionID, is_weekend, is_night FROM ev_feat""")
def f02_weekend_night(spark, sf):
    return ev_feat(spark, sf).select("TransactionID", "is_weekend", "is_night")


@query("f03_cyclic_time", EVW + """
SELECT TransactionID, round(hour_sin, 6) AS hour_sin, round(hour_cos, 6) AS hour_cos,
       round(dow_sin, 6) AS dow_sin, round(dow_cos, 6) AS dow_cos FROM ev_feat""")
def f03_cyclic_time(spark, sf):
    d = ev_feat(spark, sf)
    return d.select("TransactionID", *[r6(F.col(c)).alias(c)
                                       for c in ("hour_sin", "hour_cos", "dow_sin", "dow_cos")])


@query("f04_log_amount", ORW + """
SELECT TransactionID, round(log_amount, 6) AS log_amount FROM ord_feat""")
def f04_log_amount(spark, sf):
    return ord_feat(spark, sf).select("TransactionID", r6(F.col("log_amount")).alias("log_amount"))


@query("f05_amount_cents", ORW + """
SELECT TransactionID, amount_cents, is_round_amount FROM ord_feat""")
def f05_amount_cents(spark, sf):
    return ord_feat(spark, sf).select("TransactionID", "amount_cents", "is_round_amount")


@query("f06_amount_digits", ORW + """
SELECT TransactionID, amount_digits FROM ord_feat""")
def f06_amount_digits(spark, sf):
    return ord_feat(spark, sf).select("TransactionID", "amount_digits")


@query("f07_suspicious_domain", EVW + """
SELECT TransactionID, P_email_suspicious, R_email_suspicious FROM ev_feat""")
def f07_suspicious_domain(spark, sf):
    return ev_feat(spark, sf).select("TransactionID", "P_email_suspicious", "R_email_suspicious")


@query("f08_same_domain", EVW + """
SELECT TransactionID, P_email_same_as_R, R_email_same_as_R FROM ev_feat""")
def f08_same_domain(spark, sf):
    return ev_feat(spark, sf).select("TransactionID", "P_email_same_as_R", "R_email_same_as_R")


@query("f09_email_tld", EVW + """
SELECT TransactionID, P_email_tld, R_email_tld FROM ev_feat""")
def f09_email_tld(spark, sf):
    return ev_feat(spark, sf).select("TransactionID", "P_email_tld", "R_email_tld")


@query("f10_addr_features", ORW + """
SELECT TransactionID, addr_match, addr_combo FROM ord_feat""")
def f10_addr_features(spark, sf):
    return ord_feat(spark, sf).select("TransactionID", "addr_match", "addr_combo")


@query("f11_rule_hour", S.with_ctes(S.TXN_EVENTS) + """
SELECT TransactionID, CAST((TransactionDT // 3600) % 24 AS INTEGER) AS rule_hour FROM txn_events""")
def f11_rule_hour(spark, sf):
    return V.txn_events(spark, sf).select("TransactionID", fx.rule_hour().alias("rule_hour"))


@query("f12_rule_round_amount", S.with_ctes(S.TXN_ORDERS) + """
SELECT TransactionID,
       (CAST(trunc(TransactionAmt * 100) AS BIGINT) % 100 = 0 AND TransactionAmt > 0)
         AS rule_round_amount
FROM txn_orders""")
def f12_rule_round_amount(spark, sf):
    return V.txn_orders(spark, sf).select("TransactionID",
                                          fx.rule_round_amount().alias("rule_round_amount"))


@query("f13_rule_night", S.with_ctes(S.TXN_EVENTS) + """
SELECT TransactionID,
       coalesce(((TransactionDT // 3600) % 24) >= 22 OR ((TransactionDT // 3600) % 24) < 6, false)
         AS rule_night
FROM txn_events""")
def f13_rule_night(spark, sf):
    return V.txn_events(spark, sf).select("TransactionID",
                                          fx.rule_night(fx.rule_hour()).alias("rule_night"))


def _email_sql() -> str:
    rs = R.load_rules()
    dom = ", ".join(f"'{d}'" for d in rs.blacklists["email_domains"])
    pats = " OR ".join(f"regexp_matches(coalesce(P_emaildomain, ''), '{p}')"
                       for p in rs.email_patterns) or "false"
    part = ("CASE WHEN strpos(coalesce(P_emaildomain, ''), '@') > 0 "
            "THEN regexp_extract(P_emaildomain, '[^@]*$') ELSE coalesce(P_emaildomain, '') END")
    return S.with_ctes(S.TXN_EVENTS) + f"""
SELECT TransactionID, {part} AS email_domain,
       ({part} IN ({dom}) OR {pats}) AS suspicious_email
FROM txn_events"""


@query("f14_email_check", _email_sql())
def f14_email_check(spark, sf):
    rs = R.load_rules()
    e = F.col("P_emaildomain")
    return V.txn_events(spark, sf).select(
        "TransactionID", fx.email_domain_part(e).alias("email_domain"),
        fx.suspicious_email(e, rs.blacklists["email_domains"], rs.email_patterns)
          .alias("suspicious_email"))


# V01-V03 --------------------------------------------------------------------
@query("v01_row_validation", S.with_ctes(S.TXN_ORDERS) + f"""
SELECT TransactionID, violations, violations = '' AS is_valid FROM (
  SELECT TransactionID,
         concat_ws(',',
           CASE WHEN TransactionDT IS NULL OR TransactionDT < 0 THEN 'TransactionDT' END,
           CASE WHEN TransactionAmt IS NULL OR TransactionAmt <= 0
                     OR TransactionAmt > {VAL.MAX_AMOUNT} OR isnan(TransactionAmt)
                THEN 'TransactionAmt' END,
           CASE WHEN card1 < 0 OR card1 > {VAL.MAX_CARD1} THEN 'card1' END,
           CASE WHEN length(ProductCD) > 8 THEN 'ProductCD' END,
           CASE WHEN length(card4) > 32 THEN 'card4' END,
           CASE WHEN length(card6) > 32 THEN 'card6' END) AS violations
  FROM txn_orders)""")
def v01_row_validation(spark, sf):
    v = VAL.validate(V.txn_orders(spark, sf))
    return v.select("TransactionID", F.array_join("violations", ",").alias("violations"),
                    "is_valid")


@query("v02_amount_normalised", S.with_ctes(S.TXN_EVENTS) + """
SELECT TransactionID, round_even(TransactionAmt, 4) AS amount FROM txn_events""")
def v02_amount_normalised(spark, sf):
    return V.txn_events(spark, sf).select("TransactionID",
                                          F.bround("TransactionAmt", 4).alias("amount"))


@query("v03_batch_bounds", S.with_ctes(S.TXN_EVENTS) + f"""
SELECT TransactionID // {VAL.DEFAULT_BATCH_ROWS} AS batch_id, count(*) AS n,
       count(*) BETWEEN 1 AND {VAL.MAX_BATCH} AS within_bounds
FROM txn_events GROUP BY 1""")
def v03_batch_bounds(spark, sf):
    t = V.txn_events(spark, sf).withColumn(
        "batch_id", F.floor(F.col("TransactionID") / VAL.DEFAULT_BATCH_ROWS))
    return VAL.batch_bounds(t, "batch_id")


# V04 / V05 ------------------------------------------------------------------
ALIGN_COLS = ["TransactionAmt", "hour", "log_amount", "V1", "card1"]


@query("v04_feature_alignment", EVW + """
SELECT TransactionID, CAST(TransactionAmt AS DOUBLE) AS TransactionAmt,
       CAST(hour AS DOUBLE) AS hour, round(log_amount, 6) AS log_amount,
       0.0::DOUBLE AS V1, CAST(card1 AS DOUBLE) AS card1
FROM ev_feat""")
def v04_feature_alignment(spark, sf):
    a = P.align_features(ev_feat(spark, sf), ALIGN_COLS, keep=("TransactionID",))
    return a.withColumn("log_amount", r6(F.col("log_amount")))


# Numeric columns of the event feature frame, ids / label / helpers and text removed.
EXPECTED_EVENT_FEATURES = [
    "TransactionDT", "TransactionAmt", "card1", "C1", "failed", "hour", "day_of_week",
    "day_of_month", "month", "is_weekend", "is_night", "hour_sin", "hour_cos", "dow_sin",
    "dow_cos", "log_amount", "amount_cents", "is_round_amount", "amount_digits",
    "P_email_suspicious", "P_email_same_as_R", "R_email_suspicious", "R_email_same_as_R",
]


def _v05_sql() -> str:
    cols = []
    for c in EXPECTED_EVENT_FEATURES:
        if c in ("hour_sin", "hour_cos", "dow_sin", "dow_cos", "log_amount"):
            cols.append(f"round({c}, 6) AS {c}")
        else:
            cols.append(c)
    return EVW + "\nSELECT TransactionID, " + ", ".join(cols) + " FROM ev_feat"


@query("v05_feature_selection", _v05_sql())
def v05_feature_selection(spark, sf):
    d = ev_feat(spark, sf)
    cols = P.select_features(d)
    dbl = {"hour_sin", "hour_cos", "dow_sin", "dow_cos", "log_amount"}
    return d.select("TransactionID", *[r6(F.col(c)).alias(c) if c in dbl else F.col(c)
                                       for c in cols])


# V06 / V07 ------------------------------------------------------------------
def _v06_sql() -> str:
    ints = ["TransactionID", "TransactionDT", "card1", "isFraud"]
    parts = []
    for c in ints:
        arms = " ".join(f"WHEN min({c}) >= {lo} AND max({c}) <= {hi} THEN '{n}'"
                        for n, lo, hi in P._INT_RANGES[:3])
        parts.append(f"SELECT '{c}' AS column_name, CASE {arms} ELSE 'bigint' END AS chosen_type "
                     f"FROM txn_orders")
    for c in ["TransactionAmt", "addr1", "addr2"]:
        parts.append(f"SELECT '{c}', CASE WHEN min({c}) IS NULL OR (min({c}) >= "
                     f"-{P._FLOAT32_MAX!r} AND max({c}) <= {P._FLOAT32_MAX!r}) "
                     f"THEN 'float' ELSE 'double' END FROM txn_orders")
    return S.with_ctes(S.TXN_ORDERS) + "\n" + "\nUNION ALL ".join(parts)


@query("v06_type_narrowing", _v06_sql())
def v06_type_narrowing(spark, sf):
    return P.narrowed_types(V.txn_orders(spark, sf))


_NARROW_INTS, _NARROW_DOUBLES = ["TransactionDT", "card1", "isFraud"], ["TransactionAmt", "addr1", "addr2"]


@query("v06_narrowed_values", S.with_ctes(S.TXN_ORDERS) + "\nSELECT TransactionID, " + ", ".join(
    [f"CAST({c} AS BIGINT) AS {c}" for c in _NARROW_INTS]
    + [f"CAST(CAST({c} AS FLOAT) AS DOUBLE) AS {c}" for c in _NARROW_DOUBLES]) + " FROM txn_orders")
def v06_narrowed_values(spark, sf):
    """The values after the casts, widened again to be compared."""
    n = P.narrow(V.txn_orders(spark, sf))
    return n.select(F.col("TransactionID").cast("long"), *[F.col(c).cast("long") for c in _NARROW_INTS],
                    *[F.col(c).cast("double") for c in _NARROW_DOUBLES])


ORDERS_DTYPES = ("TransactionID:bigint,TransactionDT:bigint,TransactionAmt:double,"
                 "ProductCD:string,card1:bigint,card4:string,card6:string,addr1:double,"
                 "addr2:double,isFraud:int")


@query("v07_summary", S.with_ctes(S.TXN_ORDERS) + f"""
SELECT count(*) AS n_rows, 10 AS n_columns, '{ORDERS_DTYPES}' AS dtypes FROM txn_orders""")
def v07_summary(spark, sf):
    return VAL.summary(V.txn_orders(spark, sf))


# J01 ------------------------------------------------------------------------
@query("j01_identity_left_join", S.with_ctes(S.TXN_EVENTS, S.IDENTITY) + """
SELECT t.TransactionID, t.TransactionAmt, i.id_01, i.id_02, i.DeviceType
FROM txn_events t LEFT JOIN identity i ON t.TransactionID = i.TransactionID""")
def j01_identity_left_join(spark, sf):
    j = P.merge_identity(V.txn_events(spark, sf), V.identity(spark, sf))
    return j.select("TransactionID", "TransactionAmt", "id_01", "id_02", "DeviceType")
