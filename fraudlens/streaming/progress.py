"""Live consumer lag from query progress.

``ProgressLog`` listens to streaming queries and writes a row per source
partition and micro-batch: the offset that the batch ended at, the latest one
at the source, and the rows read. A row is some bytes and comes once a trigger;
rows are written ``every`` progress events and when the query ends, one file
each, under the run's id. Sources that number their partitions (topic ->
partition -> offset) give a row per partition, others one row with the batch's
offset; where a source does not report its latest offset the lag is unknown
(null) and no alert is raised.
"""
from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from fraudlens.operators import monitoring as MO

SCHEMA = ("query_id string, batch_id long, source int, topic string, partition int, "
          "committed_offset long, end_offset long, rows long")


def _parsed(text: str | None):
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def offset_rows(description: str, end: str | None, latest: str | None, rows: int) -> list[tuple]:
    """(topic, partition, committed_offset, end_offset, rows) of one source.
    The rows read belong to the source and stand with its first partition."""
    done, last = _parsed(end), _parsed(latest)
    nested = isinstance(done, dict) and done and all(isinstance(v, dict) for v in done.values())
    if not nested:
        number = lambda v: v if isinstance(v, int) else (
            v.get("logOffset") if isinstance(v, dict) else None)
        return [(description, 0, number(done), number(last), rows)]
    out = []
    for topic in sorted(done):
        for part in sorted(done[topic], key=int):
            newest = (last or {}).get(topic, {}).get(part) if isinstance(last, dict) else None
            out.append((topic, int(part), done[topic][part], newest, 0))
    out[0] = (*out[0][:4], rows)
    return out


class ProgressLog(StreamingQueryListener):
    """Writes the offsets of every micro-batch under ``path`` (shared storage)."""

    def __init__(self, spark: SparkSession, path: str, every: int = 20):
        self.spark, self.path, self.every = spark, path, every
        self.rows, self.files, self.ended = [], {}, threading.Event()

    def onQueryStarted(self, event):
        self.ended.clear()

    def onQueryIdle(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        for n, s in enumerate(p.sources):
            self.rows += [(str(p.id), int(p.batchId), n, *r) for r in offset_rows(
                s.description, s.endOffset, s.latestOffset, int(s.numInputRows))]
        if len(self.rows) >= self.every:
            self._flush(str(p.runId))

    def onQueryTerminated(self, event):
        self._flush(str(event.runId))
        self.ended.set()

    def _flush(self, run: str) -> None:
        rows, self.rows = self.rows, []
        if rows:
            self.files[run] = self.files.get(run, -1) + 1
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite") \
                .parquet(f"{self.path}/run={run}/file={self.files[run]}")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """One row per query, batch, source and partition, however often a batch
    was reported (a replayed one is)."""
    keys = ["query_id", "batch_id", "source", "topic", "partition"]
    return spark.read.schema(SCHEMA + ", run string, file int").parquet(path).groupBy(*keys).agg(
        F.max("committed_offset").alias("committed_offset"), F.max("end_offset").alias("end_offset"),
        F.max("rows").alias("rows"))


def live_lag(log: DataFrame) -> DataFrame:
    """T11 over the log: lag and alert per topic and partition, and the rows
    consumed so far."""
    consumed = log.groupBy("topic", "partition").agg(F.sum("rows").alias("consumed"))
    return MO.consumer_lag(log).join(consumed, ["topic", "partition"])
