"""The sustained alert as a stream fires what its batch twin fires."""
import random

import pytest
from pyspark.sql import functions as F

from fraudlens.operators import monitoring as MO
from fraudlens.session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.mark.parametrize("files", [1, 4])
def test_live_alert_equals_batch(spark, files):
    rnd = random.Random(files)
    rows = []
    for minute in range(60):
        share = 0.6 if minute in range(5, 14) or minute in range(30, 33) or minute in range(45, 60) else 0.0
        if minute not in range(20, 29):                       # windows that nothing falls into
            rows += [(1_704_067_200 + minute * 60 + rnd.randrange(60), "BLOCK" if rnd.random() < share else "ALLOW")
                     for _ in range(20)]
    rows.sort()
    frame = lambda part: spark.createDataFrame(part, "t long, decision string").select(
        F.timestamp_seconds("t").alias("ts"), "decision")
    source, out = scratch_path(spark, "decisions"), scratch_path(spark, "alerts")
    cut = -(-len(rows) // files)
    for k in range(files):
        frame(rows[k * cut:(k + 1) * cut]).coalesce(1).write.mode("append").parquet(source)
    frame([(rows[-1][0] + 7200, "ALLOW")]).coalesce(1).write.mode("append").parquet(source)
    live = (spark.readStream.schema("ts timestamp, decision string").option("maxFilesPerTrigger", 1)
            .parquet(source))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        alerts = MO.sustained_stream(MO.block_share(live.withWatermark("ts", "10 minutes")), "alert",
                                     "window_start", 30, 120)
        running = (alerts.writeStream.format("parquet").option("path", out)
                   .option("checkpointLocation", scratch_path(spark, "ck")).outputMode("append")
                   .trigger(availableNow=True).start())
        running.awaitTermination(180)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted(tuple(r) for r in spark.read.schema("run_start long, fired_at long").parquet(out).collect())
    batch = MO.sustained(MO.block_share(frame(rows)), "alert", "window_start", 30, 120).where("fired")
    want = sorted((r.run_start, r.fired_at) for r in batch.collect())
    assert got == want and len(got) >= 3
