"""Rule compiler semantics (type-directed comparisons, null / missing / NaN)."""
import math

from pyspark.sql import functions as F

from fraudlens.operators import rules as R


def _rs(cond, enabled=True, action="REVIEW", severity="LOW"):
    return R.parse_rules({"rules": [{"id": "X", "name": "x", "category": "c",
                                     "severity": severity, "action": action,
                                     "enabled": enabled, "conditions": cond}]})


def _fires(spark, rows, schema, cond):
    df = spark.createDataFrame(rows, schema)
    out = R.evaluate(df, _rs(cond), enriched=True)
    return [len(r["triggered_rules"]) == 1 for r in out.orderBy("i").collect()]


def test_ordering_coerces_and_guards(spark):
    rows = [(0, 10.0, "12"), (1, 5.0, "abc"), (2, float("nan"), " 7 "), (3, None, None)]
    schema = "i int, a double, s string"
    assert _fires(spark, rows, schema, {"field": "a", "operator": ">", "value": 6}) == \
        [True, False, False, False]
    assert _fires(spark, rows, schema, {"field": "s", "operator": ">=", "value": "7"}) == \
        [True, False, True, False]
    assert _fires(spark, rows, schema, {"field": "a", "operator": "<", "value": "x"}) == \
        [False] * 4


def test_equality_no_string_number_coercion(spark):
    rows = [(0, 1, "1", True), (1, 2, "2", False)]
    schema = "i int, n int, s string, b boolean"
    assert _fires(spark, rows, schema, {"field": "s", "operator": "==", "value": 1}) == \
        [False, False]
    assert _fires(spark, rows, schema, {"field": "s", "operator": "!=", "value": 1}) == \
        [True, True]
    assert _fires(spark, rows, schema, {"field": "b", "operator": "==", "value": 1}) == \
        [True, False]
    assert _fires(spark, rows, schema, {"field": "n", "operator": "==", "value": True}) == \
        [True, False]


def test_in_and_not_in(spark):
    rows = [(0, 60.0, "a"), (1, 61.0, "b"), (2, None, None)]
    schema = "i int, x double, s string"
    assert _fires(spark, rows, schema, {"field": "x", "operator": "in", "value": [60, "61"]}) \
        == [True, False, False]
    assert _fires(spark, rows, schema, {"field": "s", "operator": "not_in", "value": ["a"]}) \
        == [False, True, False]
    assert _fires(spark, rows, schema, {"field": "s", "operator": "in", "value": "b"}) \
        == [False, True, False]


def test_contains_secondary_unknown_missing(spark):
    rows = [(0, "AutoMobile", 100.0), (1, "house", 900.0)]
    schema = "i int, s string, a double"
    assert _fires(spark, rows, schema, {"field": "s", "operator": "contains", "value": "MOB"}) \
        == [True, False]
    cond = {"field": "a", "operator": ">", "value": 50,
            "secondary": {"field": "s", "operator": "contains", "value": "o",
                          "secondary": {"field": "a", "operator": "<", "value": 500}}}
    assert _fires(spark, rows, schema, cond) == [True, False]
    assert _fires(spark, rows, schema, {"field": "a", "operator": "~", "value": 1}) == \
        [False, False]
    assert _fires(spark, rows, schema, {"field": "zz", "operator": "!=", "value": 1}) == \
        [False, False]


def test_disabled_rules_dropped_and_shipped_set():
    rs = _rs({"field": "a", "operator": ">", "value": 1}, enabled=False)
    assert rs.rule_count == 0
    shipped = R.load_rules()
    assert shipped.rule_count == 18
    assert len({r["category"] for r in shipped.rules}) == 7


def test_enrichment_defaults_only_when_absent(spark):
    df = spark.createDataFrame([(0, None, 12345, "mailinator.com", 1000.0, 23)],
                               "i int, card_txn_count_1min long, card1 long, "
                               "P_emaildomain string, TransactionAmt double, hour int")
    rs = R.with_overrides(R.load_rules(), {})
    rs.blacklists["cards"] = ["12345"]
    e = R.enrich(df, rs).first()
    assert e["card_txn_count_1min"] is None          # present-but-null stays null
    assert e["card_txn_count_5min"] == 0             # absent -> default
    assert e["card_blacklisted"] and e["suspicious_email"]
    assert e["is_round_amount"] and e["is_night_transaction"]
    ids = [r["rule_id"] for r in R.evaluate(df, rs).first()["triggered_rules"]]
    assert "BL-001" in ids and "DEV-001" in ids and "VEL-001" not in ids
    assert "AMT-003" not in ids                      # 1000 is not > 1000
