"""Queries for the monitoring batch twins."""
from __future__ import annotations

from pyspark.sql import functions as F

from fraudlens.operators import aggregations as A
from fraudlens.operators import monitoring as MO
from fraudlens.plans import sql as S
from fraudlens.plans.q_aggregates import _cum_hist_sql
from fraudlens.plans.q_features import r6
from fraudlens.plans.q_rules import RS, events_chain_sql, stored_decisions
from fraudlens.plans.registry import query
from fraudlens.session import rocksdb, scratch_path
from fraudlens.sources import views as V

EV = events_chain_sql(RS)


def decided_ts(spark, sf):
    d = stored_decisions(spark, sf)
    return d.withColumn("ts", F.timestamp_seconds(F.lit(V.EVENTS_EPOCH) + F.col("TransactionDT")))


def _block_share_sql() -> str:
    return EV + f""",
dw AS (SELECT {V.EVENTS_EPOCH} + TransactionDT AS t, decision FROM decided),
ww AS (SELECT (t // 30) * 30 - k * 30 AS window_start, decision
       FROM dw CROSS JOIN (SELECT range AS k FROM range(10))),
bs AS (SELECT window_start, count(*) AS n,
              CAST(sum(CASE WHEN decision = 'BLOCK' THEN 1 ELSE 0 END) AS BIGINT) AS n_block
       FROM ww GROUP BY window_start)"""


@query("t05_block_share", _block_share_sql() + f"""
SELECT window_start, n, n_block, round(n_block / n, 6) AS block_share,
       n_block / n > {MO.BLOCK_SHARE_LIMIT!r} AS alert FROM bs""")
def t05_block_share(spark, sf):
    b = MO.block_share(decided_ts(spark, sf))
    return b.withColumn("block_share", r6(F.col("block_share")))


@query("t06_sustained_block_alert", _block_share_sql() + f""",
al AS (SELECT window_start FROM bs WHERE n_block / n > {MO.BLOCK_SHARE_LIMIT!r}),
isl AS (SELECT window_start, window_start // 30 - row_number() OVER (ORDER BY window_start) AS g
        FROM al)
SELECT min(window_start) AS run_start, max(window_start) AS run_end, count(*) AS n_windows,
       count(*) > 4 AS fired, CASE WHEN count(*) > 4 THEN min(window_start) + 120 END AS fired_at
FROM isl GROUP BY g""")
def t06_sustained_block_alert(spark, sf):
    b = MO.block_share(decided_ts(spark, sf))
    s = MO.sustained(b, "alert", "window_start", 30, 120)
    return s.select("run_start", "run_end", "n_windows", "fired",
                    F.col("fired_at").cast("long").alias("fired_at"))


@query("t06_stream_sustained_alert", _block_share_sql() + f""",
al AS (SELECT window_start FROM bs WHERE n_block / n > {MO.BLOCK_SHARE_LIMIT!r}),
isl AS (SELECT window_start, window_start // 30 - row_number() OVER (ORDER BY window_start) AS g
        FROM al)
SELECT min(window_start) AS run_start, min(window_start) + 120 AS fired_at
FROM isl GROUP BY g HAVING count(*) > 4""")
def t06_stream_sustained_alert(spark, sf):
    """The alert as one streaming query over the decisions: sliding-window
    share, then the keyed state of the open run. A last row an hour after the
    others moves the watermark past every window of the events."""
    source, out = scratch_path(spark, "decisions"), scratch_path(spark, "alerts")
    d = decided_ts(spark, sf).select("ts", "decision")
    closing = d.agg((F.max("ts") + F.expr("interval 1 hour")).alias("ts")).select(
        "ts", F.lit("ALLOW").alias("decision")).where("ts is not null")
    d.unionByName(closing).write.parquet(source)
    live = spark.readStream.schema("ts timestamp, decision string").parquet(source)
    shares = MO.block_share(live.withWatermark("ts", MO.DEFAULT_WATERMARK))
    with rocksdb(spark):
        running = (MO.sustained_stream(shares, "alert", "window_start", 30, 120).writeStream
                   .format("parquet").option("checkpointLocation", scratch_path(spark, "alerts-ck"))
                   .option("path", out).outputMode("append").trigger(availableNow=True).start())
    running.awaitTermination()
    return spark.read.schema("run_start long, fired_at long").parquet(out)


REQ = S.with_ctes(S.REQUESTS)


@query("t07_throughput", REQ + """
SELECT (epoch_us(ts) // 60000000) * 60 AS window_start, count(*) AS n,
       round(count(*) / 60, 6) AS per_second
FROM requests GROUP BY 1""")
def t07_throughput(spark, sf):
    t = MO.throughput(V.requests(spark, sf))
    return t.withColumn("per_second", r6(F.col("per_second")))


def _quantile_sql(q: float, bounds: list[float]) -> str:
    expr = f"{float(bounds[-1])!r}"
    for i in reversed(range(len(bounds))):
        lo = 0.0 if i == 0 else bounds[i - 1]
        prev = "0" if i == 0 else f"b{i - 1}"
        val = (f"({lo!r} + {bounds[i] - lo!r} * ({q!r} * count - {prev}) / (b{i} - {prev}))")
        expr = f"CASE WHEN b{i} >= {q!r} * count THEN {val} ELSE {expr} END"
    return f"CASE WHEN count > 0 THEN {expr} END"


def _latency_sql() -> str:
    b = A.REQUEST_LATENCY_BOUNDS
    cols = ", ".join(f"CAST(sum(CASE WHEN latency_s <= {x!r} THEN 1 ELSE 0 END) AS BIGINT) AS b{i}"
                     for i, x in enumerate(b))
    return REQ + f""",
w AS (SELECT (epoch_us(ts) // 300000000) * 300 AS window_start, {cols}, count(latency_s) AS count
      FROM requests GROUP BY 1),
q AS (SELECT window_start, count, {_quantile_sql(0.5, b)} AS p50, {_quantile_sql(0.95, b)} AS p95,
             {_quantile_sql(0.99, b)} AS p99 FROM w)
SELECT window_start, count, round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99,
       coalesce(p95 > {MO.P95_LATENCY_LIMIT!r}, false) AS alert FROM q"""


@query("t08_latency_quantiles", _latency_sql())
def t08_latency_quantiles(spark, sf):
    q = MO.latency_quantiles(V.requests(spark, sf))
    return q.select("window_start", "count", *[r6(F.col(c)).alias(c) for c in ("p50", "p95", "p99")],
                    "alert")


@query("t09_status_rates", REQ + f"""
SELECT (epoch_us(ts) // 60000000) * 60 AS window_start, status_code, count(*) AS n,
       round(count(*) / 60, 6) AS per_second,
       status_code >= 500 AND count(*) / 60 > {MO.ERROR_RATE_LIMIT!r} AS alert
FROM requests GROUP BY 1, 2""")
def t09_status_rates(spark, sf):
    r = MO.status_rates(V.requests(spark, sf))
    return r.withColumn("per_second", r6(F.col("per_second")))


def messages(spark, sf):
    ev = V.read(spark, sf, "events")
    c1 = F.get_json_object("props", "$.k").cast("long")
    return ev.select(F.col("ts").cast("timestamp").alias("ts"),
                     F.col("event_type").alias("topic"), (c1 < 90).alias("consumed"))


@query("t10_topic_counts", f"""
SELECT (epoch_us(ts) // 300000000) * 300 AS window_start, event_type AS topic,
       count(*) AS produced,
       CAST(sum(CASE WHEN {S.C1_SQL} < 90 THEN 1 ELSE 0 END) AS BIGINT) AS consumed
FROM events GROUP BY 1, 2""")
def t10_topic_counts(spark, sf):
    return MO.topic_counts(messages(spark, sf))


@query("t11_consumer_lag", S.with_ctes(S.OFFSETS) + f"""
SELECT topic, partition, max(end_offset) - max(committed_offset) AS lag,
       coalesce(max(end_offset) - max(committed_offset) > {MO.CONSUMER_LAG_LIMIT}, false) AS alert
FROM offsets GROUP BY 1, 2""")
def t11_consumer_lag(spark, sf):
    return MO.consumer_lag(V.offsets(spark, sf))


@query("t12_score_histogram_windows", EV + ",\n" + _cum_hist_sql(
    "", "(SELECTx)", "fraud_score", A.SCORE_BOUNDS, ("window_start",)).lstrip(",\n")
       .replace("FROM (SELECTx)", f"FROM (SELECT (({V.EVENTS_EPOCH} + TransactionDT) // 300) * 300 "
                                  f"AS window_start, fraud_score FROM decided)"))
def t12_score_histogram_windows(spark, sf):
    h = MO.score_histogram_windows(decided_ts(spark, sf))
    return h.withColumn("sum", r6(F.col("sum")))


@query("t03_dedup_transactions", S.with_ctes(S.TXN_EVENTS) + """
SELECT TransactionID, min(TransactionDT) AS TransactionDT FROM txn_events GROUP BY 1""")
def t03_dedup_transactions(spark, sf):
    t = V.txn_events(spark, sf).select(
        "TransactionID", "TransactionDT",
        F.timestamp_seconds(F.lit(V.EVENTS_EPOCH) + F.col("TransactionDT")).alias("ts"))
    return MO.dedup_transactions(t).select("TransactionID", "TransactionDT")
