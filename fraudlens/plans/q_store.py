"""Queries for result tables, maintenance and lookups (S06, S08, S10, U02-U06,
K01-K07, K09)."""
from __future__ import annotations

from pyspark.sql import functions as F

from fraudlens.operators import decisions as D
from fraudlens.operators import rules as R
from fraudlens.operators import store as ST
from fraudlens.plans import sql as S
from fraudlens.plans import sql_rules as SR
from fraudlens.plans.q_rules import RS, RS_LOW, events_chain_sql, stored_decisions, rule_ids
from fraudlens.plans.registry import query
from fraudlens.sources import views as V

EV = events_chain_sql(RS)
EV_LOW = events_chain_sql(RS_LOW)
MODEL = D.SCORECARD
LOOKUP_ID = 42


def _preds(spark, sf):
    return ST.predictions_table(stored_decisions(spark, sf), MODEL)


@query("s06_decision_sink", EV + """
SELECT CAST(TransactionID AS VARCHAR) AS key, decision, fraud_score FROM decided""")
def s06_decision_sink(spark, sf):
    rec = D.scoring_record(stored_decisions(spark, sf))
    msg = rec.select(F.col("transaction_id").alias("key"),
                     F.to_json(F.struct(*rec.columns)).alias("value"))
    return msg.select("key", F.get_json_object("value", "$.decision").alias("decision"),
                      F.get_json_object("value", "$.fraud_score").cast("double")
                       .alias("fraud_score"))


@query("s08_alerts", EV + f"""
SELECT '{ST.ALERT_TYPE_BLOCK}' AS alert_type, CAST(TransactionID AS VARCHAR) AS transaction_id,
       fraud_score, explanation AS message, risk_level AS severity, 'webhook' AS channel,
       false AS delivered
FROM decided WHERE decision = 'BLOCK'""")
def s08_alerts(spark, sf):
    a = ST.alerts_table(stored_decisions(spark, sf))
    return a.drop("TransactionDT")


@query("s08_alert_messages", EV + """
SELECT CAST(TransactionID AS VARCHAR) AS key, CAST(TransactionID AS VARCHAR) AS transaction_id,
       fraud_score, explanation AS message
FROM decided WHERE decision = 'BLOCK'""")
def s08_alert_messages(spark, sf):
    m = ST.alert_message(ST.alerts_table(stored_decisions(spark, sf)))
    return m.select("key", F.get_json_object("value", "$.transaction_id").alias("transaction_id"),
                    F.get_json_object("value", "$.fraud_score").cast("double").alias("fraud_score"),
                    F.get_json_object("value", "$.message").alias("message"))


@query("s10_transactions_table", EV + """
SELECT CAST(TransactionID AS VARCHAR) AS transaction_id, TransactionDT, TransactionAmt,
       ProductCD, card1 FROM decided""")
def s10_transactions_table(spark, sf):
    return ST.transactions_table(stored_decisions(spark, sf)).drop("raw_features")


@query("s10_predictions_table", EV + f"""
SELECT CAST(TransactionID AS VARCHAR) AS transaction_id, fraud_score, decision,
       {SR._q(MODEL['version'])} AS model_version, {SR._q(MODEL['name'])} AS model_name,
       {float(MODEL['threshold'])!r} AS threshold_used, rule_ids
FROM decided""")
def s10_predictions_table(spark, sf):
    p = _preds(spark, sf)
    return p.select("transaction_id", "fraud_score", "decision", "model_version", "model_name",
                    "threshold_used", rule_ids())


@query("j06_prediction_transaction_join", EV + """
SELECT CAST(TransactionID AS VARCHAR) AS transaction_id, TransactionAmt, decision FROM decided""")
def j06_prediction_transaction_join(spark, sf):
    d = stored_decisions(spark, sf)
    t = ST.transactions_table(d)
    p = ST.predictions_table(d, MODEL)
    # both sides grow with the events; their compressed files look small enough to broadcast
    return t.join(p.hint("merge"), "transaction_id").select("transaction_id", "TransactionAmt", "decision")


@query("j07_alert_transaction_join", EV + """
SELECT CAST(TransactionID AS VARCHAR) AS transaction_id, 'FRAUD_BLOCKED' AS alert_type,
       TransactionAmt FROM decided WHERE decision = 'BLOCK'""")
def j07_alert_transaction_join(spark, sf):
    d = stored_decisions(spark, sf)
    a = ST.alerts_table(d).select("transaction_id", "alert_type")
    t = ST.transactions_table(d).select("transaction_id", "TransactionAmt")
    return a.join(t.hint("merge"), "transaction_id", "left")      # t: every event, not broadcast


@query("u06_audit_records", EV + """
SELECT 'prediction' AS entity_type, CAST(TransactionID AS VARCHAR) AS entity_id,
       'create' AS action, 'scoring_job' AS actor, decision FROM decided""")
def u06_audit_records(spark, sf):
    a = ST.audit_table(stored_decisions(spark, sf))
    return a.select("entity_type", "entity_id", "action", "actor",
                    F.get_json_object("after_state", "$.decision").alias("decision"))


@query("u05_insert_unique", S.with_ctes(S.TXN_EVENTS, S.TXN_ORDERS) + """,
ex AS (SELECT CAST(TransactionID AS VARCHAR) AS transaction_id, TransactionDT, TransactionAmt
       FROM txn_orders),
nw AS (SELECT CAST(TransactionID AS VARCHAR) AS transaction_id, TransactionDT, TransactionAmt
       FROM txn_events)
SELECT * FROM ex
UNION ALL
SELECT * FROM nw WHERE transaction_id NOT IN (SELECT transaction_id FROM ex)""")
def u05_insert_unique(spark, sf):
    cols = [F.col("TransactionID").cast("string").alias("transaction_id"), "TransactionDT",
            "TransactionAmt"]
    existing = V.txn_orders(spark, sf).select(*cols)
    new = V.txn_events(spark, sf).select(*cols)
    return ST.insert_unique(existing, new, "transaction_id", "TransactionDT")


@query("u05_append_unique", S.with_ctes(S.TXN_EVENTS, S.TXN_ORDERS) + """,
ex AS (SELECT CAST(TransactionID AS VARCHAR) AS transaction_id, TransactionDT, TransactionAmt
       FROM txn_orders),
nw AS (SELECT CAST(TransactionID AS VARCHAR) AS transaction_id, TransactionDT, TransactionAmt
       FROM txn_events)
SELECT * FROM ex
UNION ALL
SELECT * FROM nw WHERE transaction_id NOT IN (SELECT transaction_id FROM ex)""")
def u05_append_unique(spark, sf):
    """Orders, then events, then both again, appended to one bucketed table."""
    from fraudlens.session import scratch_path
    cols = [F.col("TransactionID").cast("string").alias("transaction_id"), "TransactionDT",
            "TransactionAmt"]
    orders, events = V.txn_orders(spark, sf).select(*cols), V.txn_events(spark, sf).select(*cols)
    path = scratch_path(spark, "unique_ids")
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    for batch in (orders, events, orders.unionByName(events)):
        ST.append_unique(batch, table, "transaction_id", "TransactionDT", path, buckets=8)
    return spark.table(table)


def _rules_with_hits_spark(spark, sf, rs):
    rules = ST.with_hit_columns(R.rules_frame(spark, rs))
    d = stored_decisions(spark, sf, rs).withColumn(
        "TransactionDT", F.col("TransactionDT").cast("long"))
    return ST.increment_hits(rules, d)


def _rules_sql(rs: R.RuleSet) -> str:
    rows = ", ".join(f"({SR._q(r['id'])}, {SR._q(r['name'])}, {SR._q(r['category'])}, "
                     f"{SR._q(r['severity'])}, {SR._q(r['action'])}, "
                     f"{str(bool(r.get('enabled', True))).lower()})" for r in rs.rules)
    return f"""rules_t AS (SELECT * FROM (VALUES {rows})
                    t(rule_id, name, category, severity, action, enabled)),
hits AS (SELECT rule_id, count(*) AS n, max(TransactionDT) AS last_ts
         FROM (SELECT unnest(_ids) AS rule_id, TransactionDT FROM decided) GROUP BY rule_id),
rules_h AS (SELECT r.*, CAST(coalesce(h.n, 0) AS BIGINT) AS hit_count,
                   CAST(h.last_ts AS BIGINT) AS last_triggered
            FROM rules_t r LEFT JOIN hits h ON r.rule_id = h.rule_id)"""


@query("u03_rule_hit_increment", EV_LOW + ",\n" + _rules_sql(RS_LOW) + """
SELECT rule_id, hit_count, last_triggered FROM rules_h""")
def u03_rule_hit_increment(spark, sf):
    return _rules_with_hits_spark(spark, sf, RS_LOW).select("rule_id", "hit_count",
                                                            "last_triggered")


@query("u02_rule_upsert", EV_LOW + ",\n" + _rules_sql(RS_LOW) + f""",
upd AS (SELECT * FROM (VALUES {", ".join(f"({SR._q(r['id'])}, {SR._q(r['severity'])})"
                                         for r in RS.rules if r['id'] in ('VEL-001', 'VEL-002'))})
        t(rule_id, severity))
SELECT coalesce(u.rule_id, e.rule_id) AS rule_id, coalesce(u.severity, e.severity) AS severity,
       CASE WHEN u.rule_id IS NOT NULL THEN 0 ELSE e.hit_count END AS hit_count
FROM rules_h e FULL OUTER JOIN upd u ON e.rule_id = u.rule_id""")
def u02_rule_upsert(spark, sf):
    existing = _rules_with_hits_spark(spark, sf, RS_LOW)
    sync = R.RuleSet(rules=[r for r in RS.rules if r["id"] in ("VEL-001", "VEL-002")])
    upd = R.rules_frame(spark, sync)
    for c in ("name", "description", "category", "action", "enabled"):
        upd = upd.withColumn(c, F.lit(None).cast(upd.schema[c].dataType))
    out = ST.upsert_rules(existing, upd)
    return out.select("rule_id", "severity", F.col("hit_count").cast("long").alias("hit_count"))


@query("u04_mark_delivered", EV + """
SELECT CAST(d.TransactionID AS VARCHAR) AS transaction_id,
       l.doc_id IS NOT NULL AS delivered
FROM decided d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l
  ON CAST(d.TransactionID AS VARCHAR) = CAST(l.doc_id AS VARCHAR)
WHERE d.decision = 'BLOCK'""")
def u04_mark_delivered(spark, sf):
    alerts = ST.alerts_table(stored_decisions(spark, sf))
    acks = V.read(spark, sf, "labels").select(F.col("doc_id").cast("string")
                                              .alias("transaction_id"))
    return ST.mark_delivered(alerts, acks).select("transaction_id", "delivered")


@query("k01_recent_transactions", S.with_ctes(S.TXN_EVENTS) + """
SELECT CAST(TransactionID AS VARCHAR) AS transaction_id, TransactionDT, TransactionAmt
FROM txn_events ORDER BY TransactionDT DESC, TransactionID DESC LIMIT 100""")
def k01_recent_transactions(spark, sf):
    t = V.txn_events(spark, sf)
    return ST.most_recent(t, "TransactionDT", 100, "TransactionID").select(
        F.col("TransactionID").cast("string").alias("transaction_id"), "TransactionDT",
        "TransactionAmt")


@query("k02_recent_by_decision", EV + """
SELECT CAST(TransactionID AS VARCHAR) AS transaction_id, TransactionDT, fraud_score
FROM decided WHERE decision = 'BLOCK'
ORDER BY TransactionDT DESC, TransactionID DESC LIMIT 100""")
def k02_recent_by_decision(spark, sf):
    d = stored_decisions(spark, sf).where(F.col("decision") == "BLOCK")
    return ST.most_recent(d, "TransactionDT", 100, "TransactionID").select(
        F.col("TransactionID").cast("string").alias("transaction_id"), "TransactionDT",
        "fraud_score")


@query("k03_undelivered_alerts", EV + """
SELECT CAST(d.TransactionID AS VARCHAR) AS transaction_id, d.TransactionDT
FROM decided d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.TransactionID = l.doc_id
WHERE d.decision = 'BLOCK' AND l.doc_id IS NULL
ORDER BY d.TransactionDT, d.TransactionID LIMIT 50""")
def k03_undelivered_alerts(spark, sf):
    alerts = ST.alerts_table(stored_decisions(spark, sf))
    acks = V.read(spark, sf, "labels").select(F.col("doc_id").cast("string")
                                              .alias("transaction_id"))
    a = ST.mark_delivered(alerts, acks).where(~F.col("delivered"))
    a = a.withColumn("_id", F.col("transaction_id").cast("long"))
    return ST.oldest_first(a, "TransactionDT", 50, "_id").select("transaction_id",
                                                                 "TransactionDT")


@query("s14_rules_loaded", EV_LOW + ",\n" + _rules_sql(RS) + """
SELECT rule_id, name, category, severity, action, enabled FROM rules_t""")
def s14_rules_loaded(spark, sf):
    """The rule file as it is parsed now, as a table."""
    return R.rules_frame(spark, R.load_rules()).drop("description")


@query("k05_enabled_rules", EV_LOW + ",\n" + _rules_sql(RS_LOW) + """
SELECT rule_id, hit_count FROM rules_h WHERE enabled ORDER BY rule_id""")
def k05_enabled_rules(spark, sf):
    r = _rules_with_hits_spark(spark, sf, RS_LOW)
    return r.where("enabled").orderBy("rule_id").select("rule_id", "hit_count")


@query("k06_top10_rules", EV_LOW + """
SELECT rule_id, count(*) AS hits FROM (SELECT unnest(_ids) AS rule_id FROM decided)
GROUP BY rule_id ORDER BY hits DESC, rule_id LIMIT 10""")
def k06_top10_rules(spark, sf):
    return ST.top_rules_by_hits(stored_decisions(spark, sf, RS_LOW)).select("rule_id", "hits")


@query("k07_point_lookup", EV + f"""
SELECT CAST(TransactionID AS VARCHAR) AS transaction_id, fraud_score, decision
FROM decided WHERE CAST(TransactionID AS VARCHAR) = '{LOOKUP_ID}'""")
def k07_point_lookup(spark, sf):
    p = _preds(spark, sf)
    return ST.lookup(p, "transaction_id", str(LOOKUP_ID)).select("transaction_id",
                                                                 "fraud_score", "decision")


@query("k09_decision_detail", EV + """
SELECT CAST(TransactionID AS VARCHAR) AS transaction_id, fraud_score, decision,
       coalesce(risk_level, 'UNKNOWN') AS risk_level, rule_ids, coalesce(explanation, '') AS explanation
FROM decided""")
def k09_decision_detail(spark, sf):
    det = ST.decision_detail(_preds(spark, sf))
    return det.select("transaction_id", "fraud_score", "decision", "risk_level", rule_ids(),
                      "explanation")
