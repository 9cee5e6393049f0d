"""Joins of the stored decisions: no table that grows with the events goes
through the driver, and the rows are those of a plain join."""
import pytest
from pyspark.sql import functions as F

from fraudlens.plans import q_store as Q

ROWS = 3000


@pytest.fixture
def stored(spark, tmpdir_path, monkeypatch):
    d = spark.range(ROWS).select(
        F.col("id").alias("TransactionID"), F.col("id").alias("TransactionDT"),
        (F.col("id") / 4).alias("TransactionAmt"), F.lit("view").alias("ProductCD"),
        (F.col("id") % 7).alias("card1"), F.lit(0.9).alias("fraud_score"),
        F.when(F.col("id") % 10 == 0, "BLOCK").otherwise("ALLOW").alias("decision"),
        F.lit("HIGH").alias("risk_level"), F.lit("text").alias("explanation"),
        F.array(F.struct(F.lit("A").alias("rule_id"))).alias("triggered_rules"))
    d.write.mode("overwrite").parquet(f"{tmpdir_path}/joined_decisions")
    spark.range(0, ROWS, 20).select(F.col("id").alias("doc_id")) \
        .write.mode("overwrite").parquet(f"{tmpdir_path}/labels.parquet")
    monkeypatch.setattr(Q, "stored_decisions",
                        lambda spark, sf: spark.read.parquet(f"{tmpdir_path}/joined_decisions"))
    return tmpdir_path


def rows_of(df):
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    return [tuple(r) for r in df.collect()]


def test_predictions_with_their_transactions(spark, stored):
    got = rows_of(Q.j06_prediction_transaction_join(spark, stored))
    assert sorted(got, key=lambda r: int(r[0])) == [
        (str(i), i / 4, "BLOCK" if i % 10 == 0 else "ALLOW") for i in range(ROWS)]


def test_alerts_with_their_transactions(spark, stored):
    got = rows_of(Q.j07_alert_transaction_join(spark, stored))
    assert sorted(got, key=lambda r: int(r[0])) == [
        (str(i), "FRAUD_BLOCKED", i / 4) for i in range(0, ROWS, 10)]


def test_undelivered_alerts(spark, stored):
    got = rows_of(Q.k03_undelivered_alerts(spark, stored))
    assert got == [(str(i), i) for i in range(10, ROWS, 20)][:50]
