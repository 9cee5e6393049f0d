"""Decision precedence, risk levels, explanation text and actions."""
from pyspark.sql import functions as F

from fraudlens.operators import decisions as D
from fraudlens.operators import rules as R

BLOCK_RULE = {"id": "B-1", "name": "blocker", "category": "c", "severity": "HIGH",
              "action": "BLOCK", "conditions": {"field": "f", "operator": "==", "value": True}}
REVIEW_RULE = {"id": "R-1", "name": "reviewer", "category": "c", "severity": "LOW",
               "action": "REVIEW", "conditions": {"field": "g", "operator": "==", "value": True}}
CRIT_RULE = {"id": "C-1", "name": "crit", "category": "c", "severity": "CRITICAL",
             "action": "REVIEW", "conditions": {"field": "h", "operator": "==", "value": True}}


def _decide(spark, rows, block_t=0.85, review_t=0.50):
    df = spark.createDataFrame(rows, "i int, fraud_score double, f boolean, g boolean, h boolean")
    rs = R.parse_rules({"rules": [BLOCK_RULE, REVIEW_RULE, CRIT_RULE]})
    ev = R.evaluate(df, rs, enriched=True)
    return {r["i"]: r for r in D.decide(ev, block_t=block_t, review_t=review_t).collect()}


def test_threshold_edges(spark):
    out = _decide(spark, [(0, 0.92, False, False, False), (1, 0.85, False, False, False),
                          (2, 0.65, False, False, False), (3, 0.50, False, False, False),
                          (4, 0.49, False, False, False), (5, 0.10, False, False, False)])
    assert [out[i]["decision"] for i in range(6)] == \
        ["BLOCK", "BLOCK", "REVIEW", "REVIEW", "ALLOW", "ALLOW"]
    assert [out[i]["risk_level"] for i in range(6)] == \
        ["CRITICAL", "HIGH", "MEDIUM", "MEDIUM", "LOW", "LOW"]


def test_rule_precedence_and_risk(spark):
    out = _decide(spark, [(0, 0.05, True, False, False), (1, 0.05, False, True, False),
                          (2, 0.3, True, True, False), (3, 0.2, False, False, True),
                          (4, 0.2, False, True, False)])
    assert out[0]["decision"] == "BLOCK" and out[0]["risk_level"] == "HIGH"
    assert out[1]["decision"] == "REVIEW" and out[1]["risk_level"] == "MEDIUM"
    assert out[2]["decision"] == "BLOCK" and out[2]["rule_action"] == "BLOCK"
    assert out[3]["risk_level"] == "CRITICAL" and out[3]["decision"] == "REVIEW"
    # CRITICAL review keeps the standard queue text (only HIGH is special)
    assert out[3]["recommended_action"] == D.ACTION_REVIEW
    assert out[4]["risk_level"] == "MEDIUM"


def test_explanation_text(spark):
    out = _decide(spark, [(0, 0.923, True, True, False), (1, 0.1, False, False, False)])
    assert out[0]["explanation"] == (
        "ML model assigned a fraud probability of 92.3%, exceeding the block threshold of 85%. "
        "2 rule(s) triggered: B-1 (blocker, severity=HIGH); R-1 (reviewer, severity=LOW). "
        "Blocking rule(s) triggered: blocker. Final decision: BLOCK.")
    assert out[1]["explanation"] == (
        "ML model assigned a low fraud probability of 10.0%. Final decision: ALLOW.")
    assert out[1]["recommended_action"] == D.ACTION_ALLOW


def test_percent_text_matches_python(spark):
    scores = [0.0, 0.5, 0.123456, 0.999999, 0.87654, 0.33333]
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    got = [r[0] for r in df.select(D.percent_text(F.col("s"))).collect()]
    assert got == [f"{s * 100:.1f}%" for s in scores]


def test_batch_fallback_for_invalid_rows(spark):
    rows = [(1, 100, 50.0, "W", 7, "gmail.com"), (2, -5, 10.0, "W", 7, "gmail.com"),
            (3, 200, 0.0, "W", 8, None), (4, 300, 2e6, "C", 9, "mailinator.com")]
    df = spark.createDataFrame(rows, "TransactionID long, TransactionDT long, "
                                     "TransactionAmt double, ProductCD string, card1 long, "
                                     "P_emaildomain string")
    out = {r["transaction_id"]: r for r in D.score_with_fallback(df, R.load_rules()).collect()}
    assert out["1"]["error"] is None
    assert out["2"]["decision"] == "REVIEW" and out["2"]["fraud_score"] == 0.5
    assert out["2"]["error"] == "invalid: TransactionDT"
    assert out["3"]["error"] == "invalid: TransactionAmt"
    assert out["4"]["error"] == "invalid: TransactionAmt"
