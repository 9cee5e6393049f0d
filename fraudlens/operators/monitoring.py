"""Operational reports over event time (T03, T05-T12), written once for both
batch frames and streaming frames: each function only uses operators that
Structured Streaming supports (event-time ``window`` aggregates, watermark
dedup), so the batch twin is the oracle-checked copy of the stream job.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fraudlens.operators import aggregations as A

BLOCK_SHARE_LIMIT = 0.15
P95_LATENCY_LIMIT = 0.5
ERROR_RATE_LIMIT = 10.0
CONSUMER_LAG_LIMIT = 1000
DEFAULT_WATERMARK = "10 minutes"


def _start(w: str = "window") -> Column:
    return F.unix_seconds(F.col(f"{w}.start"))


# T03 ------------------------------------------------------------------------
def dedup_transactions(df: DataFrame, key: str = "TransactionID", ts: str = "ts",
                       watermark: str | None = DEFAULT_WATERMARK) -> DataFrame:
    """Stream: keep the first copy of each id seen within the watermark.
    Batch twin: keep the earliest copy per id (partial aggregate)."""
    if df.isStreaming:
        return df.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])
    cols = [c for c in df.columns if c != key]
    return (df.groupBy(key)
              .agg(F.min_by(F.struct(*cols), F.struct(F.col(ts), *[F.col(c) for c in cols]))
                    .alias("_r"))
              .select(key, "_r.*"))


# T05 ------------------------------------------------------------------------
def block_share(decided: DataFrame, ts: str = "ts", size: str = "5 minutes",
                slide: str = "30 seconds") -> DataFrame:
    g = decided.groupBy(F.window(ts, size, slide).alias("window")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("decision") == "BLOCK").cast("long")).alias("n_block"))
    return g.select(_start().alias("window_start"), "n", "n_block",
                    (F.col("n_block") / F.col("n")).alias("block_share"),
                    (F.col("n_block") / F.col("n") > BLOCK_SHARE_LIMIT).alias("alert"))


# T06 ------------------------------------------------------------------------
def sustained(windows: DataFrame, flag: str, start: str, step_seconds: int,
              hold_seconds: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Gaps and islands: runs of consecutive windows where ``flag`` holds; a run
    fires once it lasted ``hold_seconds``. The rows are per-window aggregates,
    so the ordering window is bounded by the time range, not by the data."""
    on = windows.where(F.col(flag))
    part = list(keys) or [F.lit(0)]
    w = Window.partitionBy(*part).orderBy(start)
    isl = on.withColumn("_island", (F.col(start) / step_seconds).cast("long")
                        - F.row_number().over(w))
    runs = isl.groupBy(*keys, "_island").agg(F.min(start).alias("run_start"),
                                             F.max(start).alias("run_end"),
                                             F.count(F.lit(1)).alias("n_windows"))
    need = hold_seconds // step_seconds
    return runs.select(*keys, "run_start", "run_end", "n_windows",
                       (F.col("n_windows") > need).alias("fired"),
                       F.when(F.col("n_windows") > need,
                              F.col("run_start") + F.lit(hold_seconds)).alias("fired_at"))


def sustained_stream(windows: DataFrame, flag: str, start: str, step_seconds: int,
                     hold_seconds: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """The fired runs of ``sustained`` as a live stream: (keys, run_start,
    fired_at), once per run, in the batch in which it has lasted long enough.

    ``windows`` is an append-mode window aggregate, which passes each window on
    once, when the watermark has passed its end, and never an earlier one
    later. The state of a key is the run that is open: its start, its last
    window, its length. A window without the flag, or one left out because
    nothing fell into it, ends the run. Needs the RocksDB state store."""
    from pyspark.sql.streaming import StatefulProcessor
    need, names = hold_seconds // step_seconds, list(keys) or ["_key"]
    rows = windows if keys else windows.withColumn("_key", F.lit(0))
    schema = ", ".join([*[f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in names],
                        "run_start long, fired_at long"])

    class OpenRun(StatefulProcessor):
        def init(self, handle):
            self.run = handle.getValueState("run", "first long, last long, n long")

        def handleInputRows(self, key, batches, timers):
            first, last, n = self.run.get() if self.run.exists() else (0, 0, 0)
            found = pd.concat([b[[start, flag]] for b in batches])     # one row per window
            fired = []
            for at, on in sorted(zip(found[start].tolist(), found[flag].tolist())):
                if not on:
                    n = 0
                    continue
                if n and at - last == step_seconds:
                    n += 1
                else:
                    first, n = at, 1
                last = at
                if n == need + 1:
                    fired.append((*key, first, first + hold_seconds))
            self.run.update((first, last, n))
            yield pd.DataFrame(fired, columns=[*names, "run_start", "fired_at"])

        def close(self):
            pass

    out = rows.groupBy(*names).transformWithStateInPandas(OpenRun(), schema, "Append", "None")
    return out if keys else out.drop("_key")


# T07 ------------------------------------------------------------------------
def throughput(df: DataFrame, ts: str = "ts", size: str = "1 minute", seconds: int = 60
               ) -> DataFrame:
    g = df.groupBy(F.window(ts, size).alias("window")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(_start().alias("window_start"), "n", (F.col("n") / seconds).alias("per_second"))


# T08 ------------------------------------------------------------------------
def _bucket_quantile(q: float, bounds: list[float]) -> Column:
    """Quantile from cumulative bucket counts b0..bk and total ``count``,
    linear inside the bucket; the first bucket starts at 0 and the open top
    bucket returns the last finite bound."""
    rank = F.lit(q) * F.col("count")
    expr = F.lit(float(bounds[-1]))                      # +Inf bucket
    for i in reversed(range(len(bounds))):
        lo = 0.0 if i == 0 else bounds[i - 1]
        prev = F.lit(0) if i == 0 else F.col(f"b{i - 1}")
        cur = F.col(f"b{i}")
        val = F.lit(lo) + F.lit(bounds[i] - lo) * (rank - prev) / (cur - prev)
        expr = F.when(cur >= rank, val).otherwise(expr)
    return F.when(F.col("count") > 0, expr)


def latency_quantiles(req: DataFrame, ts: str = "ts", size: str = "5 minutes",
                      bounds: list[float] = A.REQUEST_LATENCY_BOUNDS) -> DataFrame:
    v = F.col("latency_s")
    aggs = [F.sum((v <= F.lit(b)).cast("long")).alias(f"b{i}") for i, b in enumerate(bounds)]
    g = req.groupBy(F.window(ts, size).alias("window")).agg(*aggs, F.count(v).alias("count"))
    return g.select(_start().alias("window_start"), "count",
                    _bucket_quantile(0.5, bounds).alias("p50"),
                    _bucket_quantile(0.95, bounds).alias("p95"),
                    _bucket_quantile(0.99, bounds).alias("p99")) \
            .withColumn("alert", F.coalesce(F.col("p95") > P95_LATENCY_LIMIT, F.lit(False)))


# T09 ------------------------------------------------------------------------
def status_rates(req: DataFrame, ts: str = "ts", size: str = "1 minute", seconds: int = 60
                 ) -> DataFrame:
    g = req.groupBy(F.window(ts, size).alias("window"), "status_code").agg(
        F.count(F.lit(1)).alias("n"))
    rate = F.col("n") / seconds
    return g.select(_start().alias("window_start"), "status_code", "n", rate.alias("per_second"),
                    ((F.col("status_code") >= 500) & (rate > ERROR_RATE_LIMIT)).alias("alert"))


# T10 ------------------------------------------------------------------------
def topic_counts(messages: DataFrame, ts: str = "ts", size: str = "5 minutes") -> DataFrame:
    g = messages.groupBy(F.window(ts, size).alias("window"), "topic").agg(
        F.count(F.lit(1)).alias("produced"),
        F.sum(F.col("consumed").cast("long")).alias("consumed"))
    return g.select(_start().alias("window_start"), "topic", "produced", "consumed")


# T11 ------------------------------------------------------------------------
def consumer_lag(offsets: DataFrame) -> DataFrame:
    g = offsets.groupBy("topic", "partition").agg(
        (F.max("end_offset") - F.max("committed_offset")).alias("lag"))
    return g.withColumn("alert", F.coalesce(F.col("lag") > CONSUMER_LAG_LIMIT, F.lit(False)))


# T12 ------------------------------------------------------------------------
def score_histogram_windows(decided: DataFrame, ts: str = "ts", size: str = "5 minutes"
                            ) -> DataFrame:
    """Cumulative score buckets per tumbling window (``size`` in seconds)."""
    secs = size if isinstance(size, int) else _seconds(size)
    start = F.floor(F.unix_seconds(F.col(ts)) / secs) * secs
    w = decided.withColumn("window_start", start.cast("long"))
    return A.cumulative_histogram(w, "fraud_score", A.SCORE_BOUNDS, keys=("window_start",))


def _seconds(text: str) -> int:
    n, unit = text.split()
    return int(n) * {"second": 1, "seconds": 1, "minute": 60, "minutes": 60,
                     "hour": 3600, "hours": 3600}[unit]
