"""Queries for sources, sinks and blacklist joins (S01, S05, S07, S09, S11,
J04, J05, F15)."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudlens.functions import features as fx
from fraudlens.operators import rules as R
from fraudlens.operators import store as ST
from fraudlens.plans import sql as S
from fraudlens.plans.q_rules import RS, events_chain_sql, stored_decisions
from fraudlens.plans.registry import query
from fraudlens.session import materialize, scratch_path
from fraudlens.sources import io as IO
from fraudlens.sources import views as V

TOPIC = "txn-events"
EVENT_MESSAGE_SCHEMA = T.StructType([
    T.StructField("TransactionID", T.LongType()),
    T.StructField("TransactionDT", T.LongType()),
    T.StructField("TransactionAmt", T.DoubleType()),
    T.StructField("ProductCD", T.StringType()),
    T.StructField("card1", T.LongType()),
    T.StructField("P_emaildomain", T.StringType()),
    T.StructField("R_emaildomain", T.StringType()),
])


@query("s01_csv_roundtrip", S.with_ctes(S.TXN_ORDERS) + """
SELECT * FROM txn_orders""")
def s01_csv_roundtrip(spark, sf):
    path = scratch_path(spark, "csv-orders")
    IO.write_csv(V.txn_orders(spark, sf), path)
    return IO.read_transactions_csv(spark, path)


@query("s05_json_codec", S.with_ctes(S.TXN_EVENTS) + """
SELECT TransactionID, TransactionAmt, ProductCD, P_emaildomain, R_emaildomain FROM txn_events""")
def s05_json_codec(spark, sf):
    t = V.txn_events(spark, sf).select(*EVENT_MESSAGE_SCHEMA.fieldNames())
    enc = IO.encode_json(t, out="value").select("value")
    dec = IO.decode_json(enc, EVENT_MESSAGE_SCHEMA)
    return dec.select(*[F.col(f"msg.{c}").alias(c) for c in
                        ("TransactionID", "TransactionAmt", "ProductCD", "P_emaildomain",
                         "R_emaildomain")])


@query("s07_message_envelope")
def s07_message_envelope(spark, sf):
    t = V.txn_events(spark, sf).select(*EVENT_MESSAGE_SCHEMA.fieldNames())
    msgs = IO.encode_json(t.withColumn("msg_key", F.col("TransactionID")),
                          cols=EVENT_MESSAGE_SCHEMA.fieldNames())
    return IO.envelope(msgs, key="msg_key")


@query("s07_given_envelope", S.with_ctes(S.TXN_EVENTS) + """
SELECT CASE WHEN TransactionID % 5 <> 0 THEN CAST(TransactionID AS VARCHAR) END AS key,
       CASE WHEN TransactionID % 3 <> 0 THEN 'm' || TransactionID END AS message_id,
       CASE WHEN TransactionID % 7 <> 0 THEN TransactionDT END AS produced_at,
       true AS complete, 1::BIGINT AS n_same_id
FROM txn_events""")
def s07_given_envelope(spark, sf):
    """Keys, ids and times that messages bring are kept; where one is absent it
    is made (shown as null here) and made ids are all different."""
    i = F.col("TransactionID")
    t = V.txn_events(spark, sf).select(*EVENT_MESSAGE_SCHEMA.fieldNames())
    msgs = IO.encode_json(t.withColumns({
        "msg_key": F.when(i % 5 != 0, i),
        "message_id": F.when(i % 3 != 0, F.concat(F.lit("m"), i)),
        "produced_at": F.when(i % 7 != 0, F.timestamp_seconds("TransactionDT"))}),
        cols=EVENT_MESSAGE_SCHEMA.fieldNames())
    made = IO.envelope(msgs, key="msg_key")
    made = materialize(made.withColumn("i", F.get_json_object("value", "$.TransactionID").cast("long")),
                       "table")           # drawn once
    same = made.groupBy("message_id").agg(F.count(F.lit(1)).alias("n_same_id"))
    uuid = "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
    complete = (((F.col("i") % 5 != 0) | F.col("key").rlike(uuid))
                & ((F.col("i") % 3 != 0) | F.col("message_id").rlike(uuid))
                & F.col("produced_at").isNotNull())
    return made.join(same, "message_id").select(
        F.when(F.col("i") % 5 != 0, F.col("key")).alias("key"),
        F.when(F.col("i") % 3 != 0, F.col("message_id")).alias("message_id"),
        F.when(F.col("i") % 7 != 0, F.unix_seconds("produced_at")).alias("produced_at"),
        complete.alias("complete"), "n_same_id")


def _raw_topic(spark, sf):
    """Messages on one topic: event transactions as JSON plus raw page bodies
    that are not JSON at all (poison messages)."""
    t = V.txn_events(spark, sf).select(*EVENT_MESSAGE_SCHEMA.fieldNames())
    good = IO.encode_json(t, out="value").select("value")
    poison = V.read(spark, sf, "pages").select(F.col("html").alias("value"))
    return good.unionByName(poison)


@query("s09_dead_letter", """
SELECT 'txn-events' AS original_topic, html AS original_value, 'malformed_json' AS failure_reason
FROM pages""")
def s09_dead_letter(spark, sf):
    _, dead = IO.route_messages(_raw_topic(spark, sf), EVENT_MESSAGE_SCHEMA, TOPIC)
    return dead.drop("failed_at")


@query("s09_valid_messages", S.with_ctes(S.TXN_EVENTS) + """
SELECT TransactionID, TransactionAmt FROM txn_events""")
def s09_valid_messages(spark, sf):
    good, _ = IO.route_messages(_raw_topic(spark, sf), EVENT_MESSAGE_SCHEMA, TOPIC)
    return good.select("TransactionID", "TransactionAmt")


@query("s11_replay_fraud_only", S.with_ctes(S.TXN_EVENTS) + """
SELECT CAST(TransactionID AS VARCHAR) AS key,
       row_number() OVER (ORDER BY TransactionDT, TransactionID) - 1 AS _replay_index,
       'replay' AS _source, TransactionAmt
FROM txn_events WHERE isFraud = 1""")
def s11_replay_fraud_only(spark, sf):
    r = IO.replay(V.txn_events(spark, sf), fraud_only=True)
    return r.select("key", "_replay_index", "_source",
                    F.get_json_object("value", "$.TransactionAmt").cast("double")
                     .alias("TransactionAmt"))


@query("s11_replay_head", S.with_ctes(S.TXN_EVENTS) + """
SELECT CAST(TransactionID AS VARCHAR) AS key,
       row_number() OVER (ORDER BY TransactionDT, TransactionID) - 1 AS _replay_index,
       R_emaildomain IS NULL AS r_omitted
FROM txn_events ORDER BY TransactionDT, TransactionID LIMIT 100""")
def s11_replay_head(spark, sf):
    r = IO.replay(V.txn_events(spark, sf), max_records=100)
    return r.select("key", "_replay_index",
                    F.get_json_object("value", "$.R_emaildomain").isNull().alias("r_omitted"))


# A blacklist table derived from the data ---------------------------
MIN_FRAUD_FOR_BLACKLIST = 3


def card_blacklist(spark, sf):
    """Cards with at least three fraud transactions, as a blacklist table."""
    t = V.txn_events(spark, sf)
    return (t.groupBy("card1").agg(F.sum("isFraud").alias("n_fraud"))
             .where(F.col("n_fraud") >= MIN_FRAUD_FOR_BLACKLIST)
             .select(F.col("card1").alias("key")))


BL_SQL = S.with_ctes(S.TXN_EVENTS) + f""",
bl AS (SELECT CAST(card1 AS VARCHAR) AS key FROM txn_events GROUP BY card1
       HAVING sum(isFraud) >= {MIN_FRAUD_FOR_BLACKLIST})"""


@query("j04_blacklist_flags", BL_SQL + """
SELECT TransactionID, CAST(card1 AS VARCHAR) IN (SELECT key FROM bl) AS card_blacklisted
FROM txn_events""")
def j04_blacklist_flags(spark, sf):
    t = V.txn_events(spark, sf)
    f = R.blacklist_flag(t, "card1", card_blacklist(spark, sf), "card_blacklisted")
    return f.select("TransactionID", "card_blacklisted")


@query("j05_blacklist_semi", BL_SQL + """
SELECT TransactionID FROM txn_events WHERE CAST(card1 AS VARCHAR) IN (SELECT key FROM bl)""")
def j05_blacklist_semi(spark, sf):
    t = V.txn_events(spark, sf)
    return R.blacklist_select(t, "card1", card_blacklist(spark, sf), keep=True) \
            .select("TransactionID")


@query("j05_blacklist_anti", BL_SQL + """
SELECT TransactionID FROM txn_events WHERE CAST(card1 AS VARCHAR) NOT IN (SELECT key FROM bl)""")
def j05_blacklist_anti(spark, sf):
    t = V.txn_events(spark, sf)
    return R.blacklist_select(t, "card1", card_blacklist(spark, sf), keep=False) \
            .select("TransactionID")


# F15 ------------------------------------------------------------------------
@query("f15_alert_payload", events_chain_sql(RS) + f""",
al AS (SELECT CAST(TransactionID AS VARCHAR) AS transaction_id, fraud_score FROM decided
       WHERE decision = 'BLOCK')
SELECT transaction_id,
       CASE WHEN fraud_score >= {fx.ALERT_BLOCK_SCORE!r} THEN '#ff0000'
            WHEN fraud_score >= {fx.ALERT_REVIEW_SCORE!r} THEN '#ff9900' ELSE '#36a64f' END
         AS slack_color,
       CASE WHEN fraud_score >= {fx.ALERT_BLOCK_SCORE!r} THEN {0xFF0000}
            WHEN fraud_score >= {fx.ALERT_REVIEW_SCORE!r} THEN {0xFF9900} ELSE {0x36A64F} END
         AS discord_color,
       CASE WHEN fraud_score >= {fx.ALERT_BLOCK_SCORE!r} THEN 'FF0000' ELSE 'FF9900' END
         AS teams_color,
       CAST(CAST(round_even(fraud_score * 10000, 0) AS BIGINT) // 10000 AS VARCHAR) || '.' ||
         lpad(CAST(CAST(round_even(fraud_score * 10000, 0) AS BIGINT) % 10000 AS VARCHAR), 4, '0')
         AS score_text
FROM al""")
def f15_alert_payload(spark, sf):
    a = ST.alerts_table(stored_decisions(spark, sf))
    s = F.col("fraud_score")
    return a.select("transaction_id", *[c.alias(n) for n, c in fx.alert_colours(s).items()],
                    fx.score_text(s).alias("score_text"))


_SCORE_TEXT = """CAST(CAST(round_even(fraud_score * 10000, 0) AS BIGINT) // 10000 AS VARCHAR) || '.' ||
  lpad(CAST(CAST(round_even(fraud_score * 10000, 0) AS BIGINT) % 10000 AS VARCHAR), 4, '0')"""


@query("f15_alert_bodies", events_chain_sql(RS) + f"""
SELECT CAST(TransactionID AS VARCHAR) AS transaction_id,
       'Fraud alert: {ST.ALERT_TYPE_BLOCK}' AS slack_title, explanation AS slack_text,
       {_SCORE_TEXT} AS slack_score, '{fx.PRODUCT}' AS slack_footer,
       explanation AS discord_text,
       CASE WHEN fraud_score >= {fx.ALERT_BLOCK_SCORE!r} THEN {0xFF0000}
            WHEN fraud_score >= {fx.ALERT_REVIEW_SCORE!r} THEN {0xFF9900} ELSE {0x36A64F} END
         AS discord_color, false AS discord_time_inline,
       'MessageCard' AS teams_type, CAST(TransactionID AS VARCHAR) AS teams_id,
       '{ST.ALERT_TYPE_BLOCK}' AS webhook_type, fraud_score AS webhook_score
FROM decided WHERE decision = 'BLOCK'""")
def f15_alert_bodies(spark, sf):
    a = ST.alerts_table(stored_decisions(spark, sf))
    bodies = fx.alert_payloads(F.col("alert_type"), F.col("message"), F.col("fraud_score"),
                               F.col("transaction_id"), F.lit("2024-01-01T00:00:00+00:00"))
    b = a.select("transaction_id", *[c.alias(n) for n, c in bodies.items()])
    get = lambda body, path: F.get_json_object(body, path)
    return b.select(
        "transaction_id", get("slack", "$.attachments[0].title").alias("slack_title"),
        get("slack", "$.attachments[0].text").alias("slack_text"),
        get("slack", "$.attachments[0].fields[1].value").alias("slack_score"),
        get("slack", "$.attachments[0].footer").alias("slack_footer"),
        get("discord", "$.embeds[0].description").alias("discord_text"),
        get("discord", "$.embeds[0].color").cast("int").alias("discord_color"),
        get("discord", "$.embeds[0].fields[2].inline").cast("boolean").alias("discord_time_inline"),
        get("teams", "$['@type']").alias("teams_type"),
        get("teams", "$.sections[0].facts[0].value").alias("teams_id"),
        get("webhook", "$.alert_type").alias("webhook_type"),
        get("webhook", "$.fraud_score").cast("double").alias("webhook_score"))


# S02 / S03 / S13 round trips --------------------------------------------------
IDENTITY_SCHEMA = T.StructType([T.StructField("TransactionID", T.LongType()),
                                T.StructField("id_01", T.DoubleType()),
                                T.StructField("id_02", T.DoubleType()),
                                T.StructField("DeviceType", T.StringType())])


@query("s02_optional_identity_csv", S.with_ctes(S.TXN_EVENTS, S.IDENTITY) + """
SELECT t.TransactionID, i.id_01, i.DeviceType
FROM txn_events t LEFT JOIN identity i ON t.TransactionID = i.TransactionID""")
def s02_optional_identity_csv(spark, sf):
    """The identity table exported as CSV, read back only if present, left-joined."""
    from fraudlens.operators.pipeline import merge_identity
    path = scratch_path(spark, "identity-csv")
    IO.write_csv(V.identity(spark, sf), path)
    idn = IO.read_optional_csv(spark, path, IDENTITY_SCHEMA)
    if IO.read_optional_csv(spark, path + "-absent", IDENTITY_SCHEMA) is not None:
        raise RuntimeError("an absent optional table must read as None")
    j = merge_identity(V.txn_events(spark, sf), idn)
    return j.select("TransactionID", "id_01", "DeviceType")


@query("s03_split_parquet", S.with_ctes(S.TXN_ORDERS) + """
SELECT TransactionID,
       CASE WHEN row_number() OVER (ORDER BY TransactionDT, TransactionID)
                 <= (SELECT CAST(floor(count(*) * (1 - 0.2)) AS BIGINT) FROM txn_orders)
            THEN 'train' ELSE 'val' END AS split
FROM txn_orders""")
def s03_split_parquet(spark, sf):
    """Time split written as two Parquet tables and read back."""
    from fraudlens.operators import rank as RK
    t = V.txn_orders(spark, sf).select("TransactionID", "TransactionDT")
    tr, va = RK.time_split(t, 0.2)
    paths = IO.write_splits(tr, va, scratch_path(spark, "splits"))
    return (spark.read.parquet(paths["train"]).select("TransactionID", F.lit("train").alias("split"))
            .unionByName(spark.read.parquet(paths["val"])
                         .select("TransactionID", F.lit("val").alias("split"))))


@query("s13_report_roundtrip", S.with_ctes(S.TXN_ORDERS) + """
SELECT isFraud, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct
FROM txn_orders GROUP BY isFraud""")
def s13_report_roundtrip(spark, sf):
    """Report tables written as JSON; the class-count table read back."""
    from fraudlens.operators import eda
    paths = eda.write_reports(V.txn_orders(spark, sf), scratch_path(spark, "reports"))
    back = spark.read.schema("isFraud int, n long, pct double").json(paths["class_counts"])
    return back.select("isFraud", "n", F.round("pct", 6).alias("pct"))
