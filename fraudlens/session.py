"""Spark session factory and shared-folder helpers.

The session is pinned to UTC so that epoch arithmetic, hour extraction and the
DuckDB oracle agree. The UI stays off. The checkpoint folder is read from the
session (``spark.checkpoint.dir``, which a cluster points at shared storage);
only when it is unset (local tests) is a scratch folder created.
"""
from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # AQE sizes reduce partitions from runtime statistics; on a cluster set
    # spark.sql.shuffle.partitions to about input bytes / 128 MB.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    # Broadcast only what the planner can prove small; 32 MB cap.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "fraudlens", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder on shared storage")
        current = tempfile.mkdtemp(prefix="fraudlens-ckpt-")       # local runs / tests
        spark.conf.set("spark.checkpoint.dir", current)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


_SCRATCH: list[str] = []


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB (a stream takes the
    session's settings as they are when it starts)."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def release_scratch(spark: SparkSession) -> int:
    """Deletes the tables that this process has written to the shared folder;
    frames that read them must no longer be used. Returns their number."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    n = 0
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


#: Rows of a statistics or mapping table up to which it is broadcast.
SMALL_ROWS = 100_000
SALTS = 64


def join_small(df, small, keys: list[str], how: str = "left", rows: int | None = None):
    """Joins ``small`` (one row per key) to ``df`` on few and possibly hot keys.

    The table is written and counted; up to ``SMALL_ROWS`` rows it is
    broadcast, so ``df`` is not shuffled. A larger one is repeated once per
    salt and ``df``'s rows of a key are dealt over the salts. ``rows`` is the
    count where the caller knows it."""
    from pyspark.sql import functions as F
    if rows is None:
        small = materialize(small, "table")
        rows = small.count()
    if rows <= SMALL_ROWS:
        return df.join(F.broadcast(small), keys, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int")
    return df.withColumn("_salt", spread).join(salted, [*keys, "_salt"], how).drop("_salt")


def dealt(df, least_rows: int, most_rows: int):
    """The rows, written once and dealt to as many tasks as there are slots,
    of ``least_rows`` to ``most_rows`` each: for costly work per row, where
    tasks by bytes would be few."""
    table = materialize(df, "table")
    rows, slots = table.count(), df.sparkSession.sparkContext.defaultParallelism
    return table.repartition(max(1, -(-rows // most_rows), min(slots, -(-rows // least_rows))))


_CACHED: list = []


def release_cached() -> None:
    """Unpersist the frames cached by ``materialize(..., "cache")``."""
    while _CACHED:
        _CACHED.pop().unpersist()


def materialize(df, enabled: bool | str = True):
    """Cut the lineage of a multi-stage plan so later stages neither re-plan
    nor recompute the branches that a skew-safe window step duplicates.

    True / "checkpoint": a reliable checkpoint written to the shared
    checkpoint folder (survives executor loss, unlike a local checkpoint).
    "table": the frame written as a Parquet table in the same folder and read
    back (preferable for wide frames read by several later jobs).
    "cache": persist in memory and disk (short jobs such as one micro-batch;
    a lost block is recomputed from lineage). False: keep the lineage."""
    if not enabled:
        return df
    if enabled == "cache":
        from pyspark import StorageLevel
        out = df.persist(StorageLevel.MEMORY_AND_DISK)
        out.count()
        _CACHED.append(out)
        return out
    if enabled in (True, "checkpoint"):
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    path = scratch_path(df.sparkSession, "stage")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
