"""Queries for per-card windows (W01-W09); the Spark side runs the
skew-tolerant bucketed plans, the oracle the plain card-partitioned windows."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from fraudlens.operators import windows as W
from fraudlens.plans import sql as S
from fraudlens.plans.q_features import r6
from fraudlens.plans.registry import query
from fraudlens.sources import views as V

DEG = math.pi / 180


@query("w01_w03_card_sequence", S.with_ctes(S.TXN_ORDERS, S.sequence_sql("txn_orders", "seq"))
       + """
SELECT TransactionID, card_txn_rank, card_prev_dt, time_since_last_txn, rapid_succession
FROM seq""")
def w01_w03_card_sequence(spark, sf):
    s = W.sequence_features(V.txn_orders(spark, sf))
    return s.select("TransactionID", F.col("card_txn_rank").cast("long").alias("card_txn_rank"),
                    "card_prev_dt", "time_since_last_txn", "rapid_succession")


@query("w02_w03_event_gaps", S.with_ctes(S.TXN_EVENTS, S.sequence_sql("txn_events", "seq"))
       + """
SELECT TransactionID, card_txn_rank, time_since_last_txn, rapid_succession FROM seq""")
def w02_w03_event_gaps(spark, sf):
    s = W.sequence_features(V.txn_events(spark, sf), bucket_seconds=3600)
    return s.select("TransactionID", F.col("card_txn_rank").cast("long").alias("card_txn_rank"),
                    "time_since_last_txn", "rapid_succession")


def _range(n: int) -> str:
    return (f"PARTITION BY card1 ORDER BY TransactionDT "
            f"RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW")


@query("w04_velocity_counts", S.with_ctes(S.TXN_EVENTS) + f"""
SELECT TransactionID,
       count(*) OVER ({_range(60)}) AS card_txn_count_1min,
       count(*) OVER ({_range(300)}) AS card_txn_count_5min,
       count(*) OVER ({_range(3600)}) AS card_txn_count_1hour
FROM txn_events""")
def w04_velocity_counts(spark, sf):
    v = W.velocity_counts(V.txn_events(spark, sf), failed_windows={})
    return v.select("TransactionID", *W.VELOCITY_WINDOWS)


@query("w05_failed_count_30min", S.with_ctes(S.TXN_EVENTS) + f"""
SELECT TransactionID,
       CAST(sum(CAST(failed AS INTEGER)) OVER ({_range(1800)}) AS BIGINT) AS failed_txn_count_30min
FROM txn_events""")
def w05_failed_count_30min(spark, sf):
    v = W.velocity_counts(V.txn_events(spark, sf), windows={})
    return v.select("TransactionID", "failed_txn_count_30min")


@query("w06_amount_vs_30d_avg", S.with_ctes(S.TXN_EVENTS) + f"""
SELECT TransactionID, round(avg30, 6) AS card_avg_30d,
       round(coalesce(TransactionAmt / avg30, 1.0), 6) AS amount_vs_avg_ratio
FROM (SELECT *, CAST(avg(CAST(TransactionAmt AS DECIMAL(38,10))) OVER (PARTITION BY card1 ORDER BY TransactionDT
             RANGE BETWEEN {W.AVG_WINDOW_SECONDS} PRECEDING AND 1 PRECEDING) AS DOUBLE) AS avg30
      FROM txn_events)""")
def w06_amount_vs_30d_avg(spark, sf):
    v = W.amount_vs_avg(V.txn_events(spark, sf))
    return v.select("TransactionID", r6(F.col("card_avg_30d")).alias("card_avg_30d"),
                    r6(F.col("amount_vs_avg_ratio")).alias("amount_vs_avg_ratio"))


GEO_SQL = S.with_ctes(S.TXN_EVENTS, S.LOCATIONS) + f""",
cards AS (SELECT DISTINCT card1, home_country AS home FROM locations),
g AS (
  SELECT l.*, coalesce(l.txn_country <> c.home, false) AS country_mismatch
  FROM locations l LEFT JOIN cards c ON l.card1 = c.card1),
s AS (
  SELECT *,
         coalesce(sum(CAST(country_mismatch AS BIGINT)) OVER (PARTITION BY card1
             ORDER BY TransactionDT, TransactionID ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           AS intl_before,
         lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(TransactionDT) OVER w AS pdt
  FROM g WINDOW w AS (PARTITION BY card1 ORDER BY TransactionDT, TransactionID)),
k AS (
  SELECT *, CASE WHEN plat IS NOT NULL THEN 2 * {W.EARTH_RADIUS_KM!r} * asin(least(1.0, sqrt(
           pow(sin((lat - plat) * {DEG!r} / 2), 2)
           + cos(plat * {DEG!r}) * cos(lat * {DEG!r})
             * pow(sin((lon - plon) * {DEG!r} / 2), 2)))) END AS km,
         (TransactionDT - pdt) / 3600.0 AS hours
  FROM s)
SELECT TransactionID, country_mismatch,
       country_mismatch AND intl_before = 0 AS first_international,
       round(km, 6) AS travel_km,
       coalesce(CASE WHEN hours > 0 THEN km / hours WHEN km > 0 THEN 'inf'::DOUBLE ELSE 0.0 END
                > {W.MAX_TRAVEL_KMH!r}, false) AS impossible_travel
FROM k"""


@query("w07_w09_geography", GEO_SQL)
def w07_w09_geography(spark, sf):
    loc = V.locations(spark, sf)
    cards = loc.select("card1", "home_country").distinct()
    g = W.geo_features(loc, cards)
    return g.select("TransactionID", "country_mismatch", "first_international",
                    r6(F.col("travel_km")).alias("travel_km"), "impossible_travel")


# Rows without a card and repeated transaction ids ----------------------------
MESSY = """,
messy AS (
  SELECT TransactionID, TransactionDT, TransactionAmt, failed,
         CASE WHEN TransactionID % 10 = 0 THEN NULL ELSE card1 END AS card1
  FROM txn_events
  UNION ALL
  SELECT TransactionID, TransactionDT, TransactionAmt, failed,
         CASE WHEN TransactionID % 10 = 0 THEN NULL ELSE card1 END
  FROM txn_events WHERE TransactionID % 25 IN (5, 7))"""


def _messy(spark, sf):
    t = V.txn_events(spark, sf).select(
        "TransactionID", "TransactionDT", "TransactionAmt", "failed",
        F.when(F.col("TransactionID") % 10 != 0, F.col("card1")).alias("card1"))
    return t.unionByName(t.where((F.col("TransactionID") % 25).isin(5, 7)))


@query("w01_w05_null_cards_repeated_ids", S.with_ctes(S.TXN_EVENTS) + MESSY + f"""
SELECT TransactionID,
       CASE WHEN card1 IS NULL THEN 1
            ELSE row_number() OVER (PARTITION BY card1 ORDER BY TransactionDT, TransactionID)
            END AS card_txn_rank,
       CASE WHEN card1 IS NULL THEN -1 ELSE coalesce(TransactionDT - lag(TransactionDT) OVER (
            PARTITION BY card1 ORDER BY TransactionDT, TransactionID), -1) END AS time_since_last_txn,
       CASE WHEN card1 IS NULL THEN 1 ELSE count(*) OVER ({_range(60)}) END AS card_txn_count_1min,
       CASE WHEN card1 IS NULL THEN 1 ELSE count(*) OVER ({_range(3600)}) END AS card_txn_count_1hour,
       CASE WHEN card1 IS NULL THEN CAST(failed AS BIGINT)
            ELSE CAST(sum(CAST(failed AS INTEGER)) OVER ({_range(1800)}) AS BIGINT)
            END AS failed_txn_count_30min
FROM messy""")
def w01_w05_null_cards_repeated_ids(spark, sf):
    v = W.card_windows(_messy(spark, sf))
    return v.select("TransactionID", F.col("card_txn_rank").cast("long").alias("card_txn_rank"),
                    "time_since_last_txn", "card_txn_count_1min", "card_txn_count_1hour",
                    "failed_txn_count_30min")


@query("w06_null_cards_repeated_ids", S.with_ctes(S.TXN_EVENTS) + MESSY + f"""
SELECT TransactionID, round(avg30, 6) AS card_avg_30d,
       round(coalesce(TransactionAmt / avg30, 1.0), 6) AS amount_vs_avg_ratio
FROM (SELECT *, CASE WHEN card1 IS NOT NULL THEN CAST(avg(CAST(TransactionAmt AS DECIMAL(38,10))) OVER (
             PARTITION BY card1 ORDER BY TransactionDT
             RANGE BETWEEN {W.AVG_WINDOW_SECONDS} PRECEDING AND 1 PRECEDING) AS DOUBLE) END AS avg30
      FROM messy)""")
def w06_null_cards_repeated_ids(spark, sf):
    v = W.amount_vs_avg(_messy(spark, sf))
    return v.select("TransactionID", r6(F.col("card_avg_30d")).alias("card_avg_30d"),
                    r6(F.col("amount_vs_avg_ratio")).alias("amount_vs_avg_ratio"))
