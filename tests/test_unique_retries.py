"""Ids once over a stream's life, retries and bucketed unique appends."""
import json
import os

import pytest
from pyspark.sql import functions as F

from fraudlens.operators import store as ST
from fraudlens.plans.q_sources import EVENT_MESSAGE_SCHEMA
from fraudlens.streaming import jobs as J
from fraudlens.streaming import retries as RT


def _messages(path, batches):
    os.makedirs(path)
    for n, batch in enumerate(batches):
        file = os.path.join(path, f"part-{n}.json")
        with open(file, "w") as fh:
            for i, dt, card in batch:
                row = {"TransactionID": i, "TransactionDT": dt, "TransactionAmt": 5.0, "ProductCD": "W"}
                fh.write(json.dumps(row | ({} if card is None else {"card1": card})) + "\n")
        os.utime(file, (1_600_000_000 + n, 1_600_000_000 + n))


def _run(spark, folder, batches, **kw):
    _messages(os.path.join(folder, "in"), batches)
    raw = J.transaction_source(spark, EVENT_MESSAGE_SCHEMA, path=os.path.join(folder, "in"))
    out = os.path.join(folder, "out")
    q = J.score_stream(raw, EVENT_MESSAGE_SCHEMA, out, os.path.join(folder, "ck"), **kw)
    q.awaitTermination(300)
    return q, out


@pytest.mark.parametrize("within", [None, "30 days"])
def test_an_id_is_decided_once(spark, tmpdir_path, within):
    _, out = _run(spark, tmpdir_path, [
        [(1, 100, 7), (1, 100, 8), (2, 100, 7)], [(1, 101, 9), (3, 9000, 7), (4, 9000, None)],
        [(2, 100, 7), (4, 9000, None), (2, 9500, None), (5, 9500, 7)]], unique_within=within)
    keys = sorted(r["key"] for r in spark.read.parquet(f"{out}/decisions").collect())
    assert keys == ["1", "2", "3", "4", "5"]


def _attempt(rows):
    i, tries = F.col("TransactionID"), F.col(RT.ATTEMPTS)
    bad = (i == 1) | ((i == 2) & (tries < 2))
    return rows.withColumn(RT.ERROR, F.when(bad, F.lit("down")))


def test_failing_rows_are_retried_then_given_up(spark, tmpdir_path):
    """Row 1 fails for ever, row 2 twice; the others of their batch go on, and a
    repeated batch changes nothing."""
    q, out = _run(spark, tmpdir_path, [[(1, 10, 7), (2, 11, 7), (3, 12, 7)], [(4, 20, 7)]],
                  attempt=_attempt)
    first = {r["key"] for r in spark.read.parquet(f"{out}/decisions").collect()}
    assert first == {"3", "4"}
    assert RT.drain(spark, out, q.sink) == 2
    assert {r["key"] for r in spark.read.parquet(f"{out}/decisions").collect()} == {"2", "3", "4"}
    dead = spark.read.parquet(f"{out}/dead_letter").collect()
    assert [(json.loads(r["original_value"])["TransactionID"], r["failure_reason"]) for r in dead] \
        == [(1, "failed: down")]
    ledger = spark.read.parquet(f"{out}/ledger")
    tries = {r[0]: r[1] for r in ledger.groupBy("TransactionID").agg(F.max("attempts")).collect()}
    assert tries == {1: 4, 2: 3, 3: 1, 4: 1}
    last = spark.read.parquet(f"{out}/pending/batch_id=2").drop(RT.ATTEMPTS)
    q.sink(last.limit(0), 3)
    assert spark.read.parquet(f"{out}/dead_letter").count() == 1
    assert RT.drain(spark, out, q.sink) == 0


def test_default_attempt_fails_rows_without_a_score(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None), (3, float("nan"))], "id long, fraud_score double")
    assert [r["id"] for r in RT.no_score(df).where(f"{RT.ERROR} IS NOT NULL").orderBy("id").collect()] \
        == [2, 3]


def test_append_unique_moves_only_new_rows(spark, tmpdir_path):
    rows = lambda a, b, dt: spark.range(a, b).select(
        F.col("id").cast("string").alias("k"), F.lit(dt).alias("t"))
    table, path = "unique_append_test", os.path.join(tmpdir_path, "t")
    repeated = rows(0, 500, 5).unionByName(rows(0, 500, 3))
    ST.append_unique(repeated, table, "k", "t", path, buckets=8)
    ST.append_unique(rows(300, 900, 9), table, "k", "t", path, buckets=8)
    ST.append_unique(rows(300, 900, 9), table, "k", "t", path, buckets=8)
    got = {r["k"]: r["t"] for r in spark.table(table).collect()}
    assert len(got) == spark.table(table).count() == 900
    assert {got[str(i)] for i in range(500)} == {3} and got["899"] == 9
    fresh = ST.unstored(rows(0, 10, 1), table, "k", "t")
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "SortMergeJoin" in plan
    assert plan.count("Exchange hashpartitioning") == 1          # that of the new rows
    spark.sql(f"DROP TABLE {table}")
