"""DuckDB oracle building blocks: the transaction views and feature
projections written once in plain SQL over the raw driver tables.

Each constant is a CTE body; ``with_ctes`` assembles a WITH clause. Values
shared with the Spark side come from the same Python constants.
"""
from __future__ import annotations

import math

from fraudlens.functions import features as fx
from fraudlens.sources import views as V


def _case_pick(values: list[str], idx_sql: str) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {idx_sql} {arms} END"


def _in_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


C1_SQL = "CAST(regexp_extract(props, '\"k\":\\s*(-?\\d+)', 1) AS BIGINT)"
ND = len(V.EMAIL_DOMAINS)

TXN_EVENTS = f"""
txn_events AS (
  SELECT event_id AS TransactionID,
         epoch_us(ts) // 1000000 - {V.EVENTS_EPOCH} AS TransactionDT,
         value AS TransactionAmt,
         event_type AS ProductCD,
         user_id AS card1,
         {C1_SQL} AS C1,
         event_type = 'error' AS failed,
         {_case_pick(V.EMAIL_DOMAINS, f"user_id % {ND}")} AS P_emaildomain,
         CASE WHEN user_id % 3 = 0 THEN NULL
              ELSE {_case_pick(V.EMAIL_DOMAINS, f"(user_id // 2) % {ND}")} END AS R_emaildomain,
         CAST({C1_SQL} % {V.FRAUD_MOD_EVENTS} = 0 AS INTEGER) AS isFraud
  FROM events)"""

TXN_ORDERS = f"""
txn_orders AS (
  SELECT o.o_orderkey AS TransactionID,
         epoch_us(o.o_orderdate) // 1000000 - {V.ORDERS_EPOCH} AS TransactionDT,
         o.o_totalprice AS TransactionAmt,
         substr(o.o_orderpriority, 1, 1) AS ProductCD,
         o.o_custkey AS card1,
         c.c_mktsegment AS card4,
         o.o_orderstatus AS card6,
         CAST(c.c_nationkey AS DOUBLE) AS addr1,
         CAST(n.n_regionkey AS DOUBLE) AS addr2,
         CAST(o.o_orderkey % {V.FRAUD_MOD_ORDERS} = 0 AS INTEGER) AS isFraud
  FROM orders o
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

IDENTITY = """
identity AS (
  SELECT doc_id AS TransactionID,
         CAST(quality AS DOUBLE) AS id_01,
         CAST(toxic AS DOUBLE) AS id_02,
         CASE WHEN toxic = 1 THEN 'new' ELSE 'known' END AS DeviceType
  FROM labels)"""

REQUESTS = """
requests AS (
  SELECT event_id AS request_id, ts, 'POST' AS method, event_type AS endpoint,
         CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
         value / 100 AS latency_s
  FROM events)"""

OFFSETS = f"""
offsets AS (
  SELECT event_type AS topic, CAST(user_id % 3 AS INTEGER) AS partition,
         max(event_id) AS end_offset,
         max(CASE WHEN {C1_SQL} < 90 THEN event_id END) AS committed_offset
  FROM events GROUP BY 1, 2)"""

LOCATIONS = f"""
locations AS (
  SELECT TransactionID, TransactionDT, card1,
         CAST((card1 * 37) % 120 - 60 + (C1 % 10) * 0.01 AS DOUBLE) AS lat,
         CAST((card1 * 53) % 300 - 150 + CASE WHEN TransactionID % 10 = 0 THEN 25 ELSE 0 END
              + (C1 % 7) * 0.01 AS DOUBLE) AS lon,
         CAST(card1 % {V.N_COUNTRIES} AS INTEGER) AS home_country,
         CAST(CASE WHEN TransactionID % 10 = 0 THEN (card1 % {V.N_COUNTRIES} + 1) % {V.N_COUNTRIES}
              ELSE card1 % {V.N_COUNTRIES} END AS INTEGER) AS txn_country
  FROM txn_events)"""


def _ts(dt: str = "TransactionDT") -> str:
    return f"epoch_ms(({fx.FEATURE_EPOCH}::BIGINT + {dt}) * 1000)"


def tld_sql(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL THEN 'unknown' WHEN strpos({c}, '.') > 0 "
            f"THEN regexp_extract({c}, '[^.]*$') ELSE 'other' END")


TWO_PI = repr(2 * math.pi)


def row_features_sql(src: str, name: str, has_email: bool, has_addr: bool) -> str:
    """F01-F10 over a transaction CTE (mirrors pipeline.row_features)."""
    susp = _in_list(fx.SUSPICIOUS_EMAIL_DOMAINS)
    email = ""
    if has_email:
        same = "CAST(coalesce(P_emaildomain = R_emaildomain, false) AS INTEGER)"
        email = f""",
         CAST(coalesce(P_emaildomain IN ({susp}), false) AS INTEGER) AS P_email_suspicious,
         {same} AS P_email_same_as_R,
         CAST(coalesce(R_emaildomain IN ({susp}), false) AS INTEGER) AS R_email_suspicious,
         {same} AS R_email_same_as_R,
         {tld_sql('P_emaildomain')} AS P_email_tld,
         {tld_sql('R_emaildomain')} AS R_email_tld"""
    addr = ""
    if has_addr:
        addr = """,
         CAST(coalesce(addr1 = addr2, false) AS INTEGER) AS addr_match,
         CAST(coalesce(addr1, -1.0) AS VARCHAR) || '_' || CAST(coalesce(addr2, -1.0) AS VARCHAR)
           AS addr_combo"""
    return f"""
{name}_t AS (
  SELECT *, CAST(hour({_ts()}) AS INTEGER) AS hour,
         CAST(isodow({_ts()}) - 1 AS INTEGER) AS day_of_week,
         CAST(day({_ts()}) AS INTEGER) AS day_of_month, CAST(month({_ts()}) AS INTEGER) AS month
  FROM {src}),
{name} AS (
  SELECT *,
         CAST(day_of_week >= 5 AS INTEGER) AS is_weekend,
         CAST(hour >= 22 OR hour < 6 AS INTEGER) AS is_night,
         sin({TWO_PI} * hour / 24) AS hour_sin, cos({TWO_PI} * hour / 24) AS hour_cos,
         sin({TWO_PI} * day_of_week / 7) AS dow_sin, cos({TWO_PI} * day_of_week / 7) AS dow_cos,
         ln(1 + TransactionAmt) AS log_amount,
         CAST(round_even(TransactionAmt * 100, 0) AS BIGINT) AS amount_cents,
         CAST(CAST(round_even(TransactionAmt * 100, 0) AS BIGINT) % 100 = 0 AS INTEGER)
           AS is_round_amount,
         CAST(coalesce(length(CAST(CAST(trunc(TransactionAmt) AS BIGINT) AS VARCHAR)), 0)
              AS INTEGER) AS amount_digits{email}{addr}
  FROM {name}_t)"""


EVENTS_FEATURES = row_features_sql("txn_events", "ev_feat", True, False)
ORDERS_FEATURES = row_features_sql("txn_orders", "ord_feat", False, True)


def card_stats_sql(src: str, name: str) -> str:
    return f"""
{name}_stats AS (
  SELECT card1, count(TransactionAmt) AS card1_card_txn_count,
         avg(TransactionAmt) AS card1_card_amt_mean,
         stddev_samp(TransactionAmt) AS card1_card_amt_std_raw,
         min(TransactionAmt) AS card1_card_amt_min, max(TransactionAmt) AS card1_card_amt_max,
         median(TransactionAmt) AS card1_card_amt_median
  FROM {src} WHERE card1 IS NOT NULL GROUP BY card1),
{name} AS (
  SELECT t.*, s.card1_card_txn_count, s.card1_card_amt_mean,
         coalesce(s.card1_card_amt_std_raw, 0.0) AS card1_card_amt_std,
         s.card1_card_amt_min, s.card1_card_amt_max, s.card1_card_amt_median,
         (t.TransactionAmt - s.card1_card_amt_mean) / (coalesce(s.card1_card_amt_std_raw, 0.0) + 1e-8)
           AS card_amt_zscore,
         t.TransactionAmt / (s.card1_card_amt_max + 1e-8) AS card_amt_vs_max
  FROM {src} t LEFT JOIN {name}_stats s ON t.card1 = s.card1)"""


def sequence_sql(src: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT *, row_number() OVER w AS card_txn_rank,
         lag(TransactionDT) OVER w AS card_prev_dt,
         coalesce(TransactionDT - lag(TransactionDT) OVER w, -1) AS time_since_last_txn,
         CAST(coalesce(TransactionDT - lag(TransactionDT) OVER w, -1) > 0
              AND coalesce(TransactionDT - lag(TransactionDT) OVER w, -1) < 60 AS INTEGER)
           AS rapid_succession
  FROM {src}
  WINDOW w AS (PARTITION BY card1 ORDER BY TransactionDT, TransactionID))"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes)


def loc_cols_sql() -> str:
    n = V.N_COUNTRIES
    return f"""CAST((card1 * 37) % 120 - 60 + (C1 % 10) * 0.01 AS DOUBLE) AS lat,
         CAST((card1 * 53) % 300 - 150 + CASE WHEN TransactionID % 10 = 0 THEN 25 ELSE 0 END
              + (C1 % 7) * 0.01 AS DOUBLE) AS lon,
         CAST(card1 % {n} AS INTEGER) AS home_country,
         CAST(CASE WHEN TransactionID % 10 = 0 THEN (card1 % {n} + 1) % {n}
              ELSE card1 % {n} END AS INTEGER) AS txn_country"""


def velocity_sql(src: str, name: str) -> str:
    from fraudlens.operators import windows as W

    def rng(n):
        return (f"PARTITION BY card1 ORDER BY TransactionDT "
                f"RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW")
    return f"""
{name}_a AS (
  SELECT *,
         count(*) OVER ({rng(60)}) AS card_txn_count_1min,
         count(*) OVER ({rng(300)}) AS card_txn_count_5min,
         count(*) OVER ({rng(3600)}) AS card_txn_count_1hour,
         CAST(coalesce(sum(CAST(failed AS INTEGER)) OVER ({rng(1800)}), 0) AS BIGINT)
           AS failed_txn_count_30min,
         CAST(avg(CAST(TransactionAmt AS DECIMAL(38,10))) OVER (PARTITION BY card1
              ORDER BY TransactionDT RANGE BETWEEN {W.AVG_WINDOW_SECONDS} PRECEDING
              AND 1 PRECEDING) AS DOUBLE) AS card_avg_30d
  FROM {src}),
{name} AS (
  SELECT *, coalesce(TransactionAmt / card_avg_30d, 1.0) AS amount_vs_avg_ratio FROM {name}_a)"""


def geo_sql(src: str, name: str) -> str:
    """W07-W09 over a frame that carries lat, lon, home_country, txn_country."""
    from fraudlens.operators import windows as W
    r = repr(math.pi / 180)
    return f"""
{name}_c AS (SELECT DISTINCT card1, home_country AS _home FROM {src}),
{name}_g AS (
  SELECT s.*, coalesce(s.txn_country <> c._home, false) AS country_mismatch
  FROM {src} s LEFT JOIN {name}_c c ON s.card1 = c.card1),
{name}_s AS (
  SELECT *,
         coalesce(sum(CAST(country_mismatch AS BIGINT)) OVER (PARTITION BY card1
             ORDER BY TransactionDT, TransactionID ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           AS _intl_before,
         lag(lat) OVER _w AS prev_lat, lag(lon) OVER _w AS prev_lon, lag(TransactionDT) OVER _w AS prev_dt
  FROM {name}_g WINDOW _w AS (PARTITION BY card1 ORDER BY TransactionDT, TransactionID)),
{name}_k AS (
  SELECT *, CASE WHEN prev_lat IS NOT NULL THEN 2 * {W.EARTH_RADIUS_KM!r} * asin(least(1.0, sqrt(
           pow(sin((lat - prev_lat) * {r} / 2), 2)
           + cos(prev_lat * {r}) * cos(lat * {r}) * pow(sin((lon - prev_lon) * {r} / 2), 2))))
           END AS travel_km,
         (TransactionDT - prev_dt) / 3600.0 AS _hours
  FROM {name}_s),
{name} AS (
  SELECT * EXCLUDE (_intl_before, _hours),
         country_mismatch AND _intl_before = 0 AS first_international,
         coalesce(CASE WHEN _hours > 0 THEN travel_km / _hours WHEN travel_km > 0
                       THEN 'inf'::DOUBLE ELSE 0.0 END > {W.MAX_TRAVEL_KMH!r}, false)
           AS impossible_travel
  FROM {name}_k)"""
