"""Streams at size: messages parsed once, one state of ids, many message files."""
import glob
import os

from pyspark.sql import functions as F

from fraudlens.operators import windows as W
from fraudlens.plans import q_streams as Q
from fraudlens.plans.q_sources import EVENT_MESSAGE_SCHEMA
from fraudlens.sources import io as IO
from fraudlens.streaming import jobs as J


def _events(spark, n=240):
    """Events of six cards and, every tenth, of none."""
    return spark.range(n).select(
        F.col("id").alias("TransactionID"), (F.col("id") * 37 % 7200).alias("TransactionDT"),
        (F.col("id") + 1.0).alias("TransactionAmt"), F.lit("p").alias("ProductCD"),
        F.when(F.col("id") % 10 != 0, F.col("id") % 6).alias("card1"),
        F.lit("a.com").alias("P_emaildomain"), F.lit(None).cast("string").alias("R_emaildomain"))


def test_a_message_is_parsed_once(spark, tmpdir_path):
    lines = IO.encode_json(_events(spark, 20), out="value").select("value").unionByName(
        spark.createDataFrame([("{bad",), ('{"TransactionID":7}',), ("null",)], "value string"))
    path = os.path.join(tmpdir_path, "lines")
    lines.write.text(path)
    good, dead = IO.route_messages(spark.read.text(path), EVENT_MESSAGE_SCHEMA, "t")
    for rows in (good, dead):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert good.count() == 20
    assert sorted(r["failure_reason"] for r in dead.collect()) == [
        "invalid: TransactionDT,TransactionAmt", "malformed_json", "malformed_json"]


def test_rows_without_a_card_need_no_second_state_of_ids(spark, tmpdir_path):
    """One state of ids in the plan; rows with and without a card get what the
    windows give."""
    t = _events(spark)
    path = os.path.join(tmpdir_path, "events")
    t.unionByName(t.where("TransactionID % 3 = 0")).write.parquet(path)
    stream = J.with_card_state(J.unique_ids(spark.readStream.schema(t.schema).parquet(path)))
    assert stream._jdf.queryExecution().analyzed().toString().count("Deduplicate") == 1
    assert stream.columns == [*t.columns, "failed", *[n for n, _ in J.STATE_COLUMNS]]
    q = stream.writeStream.format("memory").queryName("no_card_out").outputMode("append") \
        .option("checkpointLocation", os.path.join(tmpdir_path, "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    names = ["card_txn_rank", "time_since_last_txn", *W.VELOCITY_WINDOWS]
    want = W.velocity_counts(W.sequence_features(t))
    rows = lambda d: sorted(tuple(r) for r in d.select("TransactionID", *names).collect())
    assert rows(spark.table("no_card_out")) == rows(want)
    none = spark.table("no_card_out").where("card1 is null")
    assert none.count() == 24 and none.where(
        "card_prev_dt is null and amount_vs_avg_ratio = 1 and not is_late and failed_txn_count_30min = 0").count() == 24


def test_repeated_ids_are_written_by_many_tasks(spark, tmpdir_path, monkeypatch):
    """t03's messages do not pass through one task, and later copies come in a
    batch of their own."""
    n = 400
    sf = os.path.join(tmpdir_path, "sf")
    spark.range(n).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60).alias("ts"),
        (F.col("id") % 8).alias("user_id"), F.lit("view").alias("event_type"), F.lit(5.0).alias("value"),
        F.lit('{"k": 3}').alias("props")).repartition(4).write.parquet(f"{sf}/events.parquet")
    made, new = {}, Q.scratch_path
    monkeypatch.setattr(Q, "scratch_path", lambda s, name: made.setdefault(name, new(s, name)))
    got = Q.t03_stream_unique_ids(spark, sf)
    assert got.count() == n and got.where("n <> 1").count() == 0
    files = [f for f in glob.glob(made["messages"].removeprefix("file:") + "/part-*") if os.path.getsize(f)]
    assert len(files) > 2
    batches = glob.glob(made["stream-out"].removeprefix("file:") + "/decisions/batch_id=*")
    assert len(batches) == 2
