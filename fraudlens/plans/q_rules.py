"""Queries for the rule engine and decisions."""
from __future__ import annotations

import json

from pyspark.sql import functions as F

from fraudlens.operators import aggregations as A
from fraudlens.operators import decisions as D
from fraudlens.operators import rules as R
from fraudlens.plans import sql as S
from fraudlens.plans import sql_rules as SR
from fraudlens.plans.q_aggregates import _cum_hist_sql
from fraudlens.plans.registry import query
from fraudlens.session import _SCRATCH, scratch_path
from fraudlens.sources import views as V
from fraudlens.sources.io import path_exists

# Velocity limits low enough to fire on the driver's event rates
# (they peak at about 2 per minute and 3 per hour at sf 0.01).
LOW_LIMITS = {"VEL-001": 1, "VEL-002": 1, "VEL-003": 2, "BEH-001": 1}

EVENT_KINDS = {
    "TransactionAmt": "num", "card1": "num", "card_txn_count_1min": "num",
    "card_txn_count_5min": "num", "card_txn_count_1hour": "num",
    "failed_txn_count_30min": "num", "amount_vs_avg_ratio": "num",
    "is_round_amount": "bool", "impossible_travel": "bool", "country_mismatch": "bool",
    "first_international": "bool", "card_blacklisted": "bool", "merchant_blacklisted": "bool",
    "customer_blacklisted": "bool", "suspicious_email": "bool",
    "is_night_transaction": "bool", "DeviceType": "str", "ProductCD": "str",
}
ORDER_KINDS = {
    "TransactionAmt": "num", "card1": "num", "addr1": "num", "addr2": "num",
    "card_txn_count_1min": "num", "card_txn_count_5min": "num", "card_txn_count_1hour": "num",
    "amount_vs_avg_ratio": "num", "is_round_amount": "bool", "card_blacklisted": "bool",
    "merchant_blacklisted": "bool", "customer_blacklisted": "bool", "suspicious_email": "bool",
    "is_night_transaction": "bool", "ProductCD": "str", "card4": "str", "card6": "str",
}


def _enrich_sql(rs: R.RuleSet, src: str, name: str, has_email: bool) -> str:
    """R08 in SQL: blacklist flags, email check, rule-side round / night flags."""
    def bl(col, keys):
        return (f"coalesce(CAST({col} AS VARCHAR) IN ({', '.join(SR._q(k) for k in keys)}), false)"
                if keys else "false")
    if has_email:
        e = "coalesce(P_emaildomain, '')"
        dom = (f"CASE WHEN strpos({e}, '@') > 0 THEN regexp_extract({e}, '[^@]*$') ELSE {e} END")
        doms = rs.blacklists["email_domains"]
        hit = [f"{dom} IN ({', '.join(SR._q(d) for d in doms)})"] if doms else []
        hit += [f"regexp_matches({e}, {SR._q(p)})" for p in rs.email_patterns]
        susp = "(" + " OR ".join(hit) + ")" if hit else "false"
    else:
        susp = "false"
    hour = "((TransactionDT // 3600) % 24)"
    return f"""
{name} AS (
  SELECT * REPLACE (
           (CAST(trunc(coalesce(TransactionAmt, 0.0) * 100) AS BIGINT) % 100 = 0
            AND coalesce(TransactionAmt, 0.0) > 0) AS is_round_amount),
         {bl('card1', rs.blacklists['cards'])} AS card_blacklisted,
         {bl('ProductCD', rs.blacklists['merchants'])} AS merchant_blacklisted,
         {bl('addr1', rs.blacklists['customers']) if not has_email else 'false'} AS customer_blacklisted,
         {susp} AS suspicious_email,
         coalesce({hour} >= 22 OR {hour} < 6, false) AS is_night_transaction
  FROM {src})"""


def events_chain_sql(rs: R.RuleSet) -> str:
    """CTE chain: events -> features -> windows -> geography -> identity ->
    scorecard -> enrichment -> rules -> decision columns (CTE ``decided``)."""
    return S.with_ctes(
        S.TXN_EVENTS, S.IDENTITY, S.EVENTS_FEATURES,
        S.card_stats_sql("ev_feat", "ev_cs"),
        S.sequence_sql("ev_cs", "ev_seq"),
        S.velocity_sql("ev_seq", "ev_vel"),
        f"ev_loc AS (SELECT *, {S.loc_cols_sql()} FROM ev_vel)",
        S.geo_sql("ev_loc", "ev_geo"),
        """ev_id AS (SELECT g.*, i.DeviceType FROM ev_geo g
                  LEFT JOIN identity i ON g.TransactionID = i.TransactionID)""",
        f"ev_sc AS (SELECT *, {SR.scorecard_sql()} AS fraud_score FROM ev_id)",
        _enrich_sql(rs, "ev_sc", "ev_en", True),
        f"ev_rl AS (SELECT *, {SR.rule_lists_sql(rs, EVENT_KINDS)} FROM ev_en)",
        f"ev_dc AS (SELECT *, {SR.decision_sql()} FROM ev_rl)",
        f"decided AS ({SR.final_sql('SELECT * FROM ev_dc', 'TransactionID, TransactionDT, card1, ProductCD, TransactionAmt, fraud_score, _ids, ')})",
    )


def orders_chain_sql(rs: R.RuleSet) -> str:
    card = {k: v for k, v in D.SCORECARD.items()}
    card["coefficients"] = {k: v for k, v in D.SCORECARD["coefficients"].items()
                            if k != "P_email_suspicious"}
    return S.with_ctes(
        S.TXN_ORDERS, S.ORDERS_FEATURES,
        S.card_stats_sql("ord_feat", "or_cs"),
        S.sequence_sql("or_cs", "or_seq"),
        S.velocity_sql("or_seq", "or_vel").replace(
            "CAST(coalesce(sum(CAST(failed AS INTEGER))", "CAST(coalesce(sum(CAST(0 AS INTEGER))"),
        f"or_sc AS (SELECT *, {SR.scorecard_sql(card)} AS fraud_score FROM or_vel)",
        _enrich_sql(rs, "or_sc", "or_en", False),
        f"or_rl AS (SELECT *, {SR.rule_lists_sql(rs, ORDER_KINDS)} FROM or_en)",
        f"or_dc AS (SELECT *, {SR.decision_sql()} FROM or_rl)",
        f"decided AS ({SR.final_sql('SELECT * FROM or_dc', 'TransactionID, TransactionDT, card1, ProductCD, TransactionAmt, fraud_score, _ids, ')})",
    )


# ---------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------
_STORED: dict[tuple, str] = {}


def stored_decisions(spark, sf, rs: R.RuleSet | None = None):
    """The decided events as a table, scored once per session: what reports,
    alerts and lookups read, so their filters and columns reach the scan. They
    are scored again where the shared folder has been emptied meanwhile."""
    rs = rs or R.load_rules()
    key = (spark.sparkContext.applicationId, sf, json.dumps(rs.rules, sort_keys=True, default=str))
    if _STORED.get(key) not in _SCRATCH or not path_exists(spark, f"{_STORED[key]}/_SUCCESS"):
        path = scratch_path(spark, "decisions")
        events_decided(spark, sf, rs).write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def events_decided(spark, sf, rs: R.RuleSet | None = None):
    txn = V.txn_events(spark, sf).withColumns(V.location_columns())
    return D.scoring_frame(txn, rs or R.load_rules(), cards=V.card_countries(spark, sf),
                           identity=V.identity(spark, sf).select("TransactionID", "DeviceType"))


def orders_decided(spark, sf, rs: R.RuleSet | None = None):
    return D.scoring_frame(V.txn_orders(spark, sf), rs or R.load_rules())


def rule_ids(col: str = "triggered_rules"):
    return F.array_join(F.transform(F.col(col), lambda r: r["rule_id"]), ",").alias("rule_ids")


def _decision_out(df):
    return df.select("TransactionID", "fraud_score", rule_ids(), "rule_action", "decision",
                     "risk_level", "explanation", "recommended_action")


_DEC_COLS = ("TransactionID, fraud_score, rule_ids, rule_action, decision, risk_level, "
             "explanation, recommended_action")

RS = R.load_rules()
RS_LOW = R.with_overrides(RS, LOW_LIMITS)


@query("d08_scoring_record", events_chain_sql(RS) + f"""
SELECT CAST(TransactionID AS VARCHAR) AS transaction_id, fraud_score, rule_ids, rule_action,
       decision, risk_level, explanation, recommended_action,
       {SR._q(D.SCORECARD['name'])} AS model_name, {SR._q(D.SCORECARD['version'])} AS model_version,
       {float(D.SCORECARD['threshold'])!r} AS model_threshold
FROM decided""")
def d08_scoring_record(spark, sf):
    rec = D.scoring_record(events_decided(spark, sf))
    return rec.select("transaction_id", "fraud_score", rule_ids(), "rule_action", "decision",
                      "risk_level", "explanation", "recommended_action",
                      F.col("model_info.name").alias("model_name"),
                      F.col("model_info.version").alias("model_version"),
                      F.col("model_info.threshold").alias("model_threshold"))


@query("r09_rules_low_limits", events_chain_sql(RS_LOW) + f"""
SELECT TransactionID, rule_ids FROM decided""")
def r09_rules_low_limits(spark, sf):
    return events_decided(spark, sf, RS_LOW).select("TransactionID", rule_ids())


@query("d01_d06_decisions_orders", orders_chain_sql(RS) + f"""
SELECT {_DEC_COLS} FROM decided""")
def d01_d06_decisions_orders(spark, sf):
    return _decision_out(orders_decided(spark, sf))


@query("r10_shipped_rules_orders", orders_chain_sql(RS) + """
SELECT TransactionID, rule_ids FROM decided""")
def r10_shipped_rules_orders(spark, sf):
    return orders_decided(spark, sf).select("TransactionID", rule_ids())


# A rule set that exercises every operator and coercion case.
OPERATOR_RULES = R.parse_rules({"rules": [
    {"id": "T-GE", "name": "ge", "category": "t", "severity": "LOW", "action": "REVIEW",
     "conditions": {"field": "TransactionAmt", "operator": ">=", "value": 400000}},
    {"id": "T-LT", "name": "lt", "category": "t", "severity": "LOW", "action": "REVIEW",
     "conditions": {"field": "TransactionAmt", "operator": "<", "value": "2000"}},
    {"id": "T-LE", "name": "le", "category": "t", "severity": "HIGH", "action": "REVIEW",
     "conditions": {"field": "card1", "operator": "<=", "value": 10}},
    {"id": "T-NE", "name": "ne", "category": "t", "severity": "LOW", "action": "REVIEW",
     "conditions": {"field": "card4", "operator": "!=", "value": "BUILDING"}},
    {"id": "T-IN", "name": "in_num", "category": "t", "severity": "LOW", "action": "REVIEW",
     "conditions": {"field": "addr1", "operator": "in", "value": [1, 2.0, "3"]}},
    {"id": "T-NOTIN", "name": "not_in_str", "category": "t", "severity": "LOW",
     "action": "REVIEW",
     "conditions": {"field": "card6", "operator": "not_in", "value": ["F", "O"]}},
    {"id": "T-CONT", "name": "contains", "category": "t", "severity": "LOW", "action": "REVIEW",
     "conditions": {"field": "card4", "operator": "contains", "value": "MoBiLe"}},
    {"id": "T-EQX", "name": "eq_str_num", "category": "t", "severity": "LOW",
     "action": "REVIEW",
     "conditions": {"field": "ProductCD", "operator": "==", "value": 1}},
    {"id": "T-NEX", "name": "ne_str_num", "category": "t", "severity": "LOW",
     "action": "REVIEW",
     "conditions": {"field": "ProductCD", "operator": "!=", "value": 1}},
    {"id": "T-GTS", "name": "gt_str", "category": "t", "severity": "LOW", "action": "BLOCK",
     "conditions": {"field": "ProductCD", "operator": ">", "value": 3}},
    {"id": "T-SEC", "name": "secondary", "category": "t", "severity": "CRITICAL",
     "action": "BLOCK",
     "conditions": {"field": "TransactionAmt", "operator": ">", "value": 100000,
                    "secondary": {"field": "card6", "operator": "==", "value": "F",
                                  "secondary": {"field": "addr2", "operator": "in",
                                                "value": [0, 1]}}}},
    {"id": "T-UNK", "name": "unknown_op", "category": "t", "severity": "LOW",
     "action": "REVIEW",
     "conditions": {"field": "TransactionAmt", "operator": "~=", "value": 1}},
    {"id": "T-MISS", "name": "missing_field", "category": "t", "severity": "LOW",
     "action": "REVIEW",
     "conditions": {"field": "no_such_column", "operator": "!=", "value": 1}},
    {"id": "T-BOOL", "name": "bool_eq_one", "category": "t", "severity": "LOW",
     "action": "REVIEW",
     "conditions": {"field": "is_round_amount", "operator": "==", "value": 1}},
    {"id": "T-CB", "name": "contains_bool", "category": "t", "severity": "LOW",
     "action": "REVIEW",
     "conditions": {"field": "is_round_amount", "operator": "contains", "value": "TRU"}},
    {"id": "T-SCAL", "name": "in_scalar", "category": "t", "severity": "LOW",
     "action": "REVIEW",
     "conditions": {"field": "ProductCD", "operator": "in", "value": "5"}},
    {"id": "T-BAD", "name": "bad_literal", "category": "t", "severity": "LOW",
     "action": "REVIEW",
     "conditions": {"field": "TransactionAmt", "operator": ">", "value": "abc"}},
    {"id": "T-OFF", "name": "disabled", "category": "t", "severity": "LOW", "action": "BLOCK",
     "enabled": False,
     "conditions": {"field": "TransactionAmt", "operator": ">", "value": 0}},
]})


def _operator_sql() -> str:
    kinds = dict(ORDER_KINDS)
    return S.with_ctes(S.TXN_ORDERS,
                       "ord_x AS (SELECT *, false AS is_round_amount FROM txn_orders)",
                       _enrich_sql(OPERATOR_RULES, "ord_x", "en", False)) + \
        f"""
SELECT TransactionID, array_to_string(_ids, ',') AS rule_ids
FROM (SELECT *, {SR.rule_lists_sql(OPERATOR_RULES, kinds)} FROM en)"""


@query("r02_r07_operator_semantics", _operator_sql())
def r02_r07_operator_semantics(spark, sf):
    ev = R.evaluate(V.txn_orders(spark, sf), OPERATOR_RULES)
    return ev.select("TransactionID", rule_ids())


# A13-A15 over the event decisions -------------------------------------------
@query("a13_count_by_decision", events_chain_sql(RS) + """
SELECT decision, count(*) AS n FROM decided GROUP BY decision""")
def a13_count_by_decision(spark, sf):
    return A.decision_counts(events_decided(spark, sf))


@query("a14_decision_risk_counts", events_chain_sql(RS) + """
SELECT decision, risk_level, count(*) AS n FROM decided GROUP BY 1, 2""")
def a14_decision_risk_counts(spark, sf):
    return A.decision_counts(events_decided(spark, sf), ("decision", "risk_level"))


def _rule_meta_sql(rs: R.RuleSet, field: str) -> str:
    arms = " ".join(f"WHEN {SR._q(r['id'])} THEN {SR._q(r[field])}" for r in rs.rules)
    return f"CASE rule_id {arms} END"


@query("a15_rule_hits", events_chain_sql(RS_LOW) + f"""
SELECT rule_id, {_rule_meta_sql(RS_LOW, 'category')} AS category,
       {_rule_meta_sql(RS_LOW, 'action')} AS action, count(*) AS hits
FROM (SELECT unnest(_ids) AS rule_id FROM decided) GROUP BY 1, 2, 3""")
def a15_rule_hits(spark, sf):
    return A.rule_hits(events_decided(spark, sf, RS_LOW))


@query("d07_batch_with_fallback", orders_chain_sql(RS) + """,
v AS (SELECT TransactionID FROM txn_orders
      WHERE NOT (TransactionDT >= 0 AND TransactionAmt > 0 AND TransactionAmt <= 1000000))
SELECT CAST(TransactionID AS VARCHAR) AS transaction_id, fraud_score, decision,
       CAST(NULL AS VARCHAR) AS error FROM decided
UNION ALL
SELECT CAST(TransactionID AS VARCHAR), 0.5, 'REVIEW', 'invalid: TransactionAmt' FROM v""")
def d07_batch_with_fallback(spark, sf):
    return D.score_with_fallback(V.txn_orders(spark, sf), RS)


@query("a16_score_histogram", events_chain_sql(RS) + ",\n" + _cum_hist_sql(
        "", "decided", "fraud_score", A.SCORE_BOUNDS).lstrip(",\n"))
def a16_score_histogram(spark, sf):
    h = A.cumulative_histogram(events_decided(spark, sf), "fraud_score", A.SCORE_BOUNDS)
    return h.withColumn("sum", F.round("sum", 6))
