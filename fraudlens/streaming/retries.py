"""Messages that fail are tried again, a fixed number of times.

Every micro-batch tries its own rows and those that the batch before left
pending. A row that fails is pending for the next batch until it has failed
``MAX_RETRIES`` + 1 times; then it is given up and the rest of the batch goes
on. All tables are written under the batch's number and a batch reads the
tables of earlier numbers only, so a replayed batch repeats its work and
overwrites itself. Rows pending after the last batch are tried by ``drain``.

An attempt is a function of rows (with ``ATTEMPTS``, the failures so far) that
adds ``ERROR``, null where the row succeeded; it keeps the other columns.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_RETRIES = 3
ATTEMPTS, ERROR = "_attempts", "_error"
Attempt = Callable[[DataFrame], DataFrame]


def no_score(rows: DataFrame) -> DataFrame:
    """The default attempt: a row without a score has failed."""
    s = F.col("fraud_score")
    return rows.withColumn(ERROR, F.when(s.isNull() | F.isnan(s), F.lit("no score")))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _pending_path(ledger: str, number: int) -> str:
    return f"{ledger}/pending/batch_id={number}"


def with_pending(rows: DataFrame, ledger: str, number: int) -> DataFrame:
    """The batch's rows and those that the batch before left."""
    fresh = rows.withColumn(ATTEMPTS, F.lit(0))
    before = _pending_path(ledger, number - 1)
    spark = rows.sparkSession
    if number < 1 or not _exists(spark, before):
        return fresh
    return fresh.unionByName(spark.read.schema(fresh.schema).parquet(before))


def settle(rows: DataFrame, attempt: Attempt, ledger: str, number: int, key: str = "TransactionID",
           max_retries: int = MAX_RETRIES) -> tuple[DataFrame, DataFrame]:
    """(succeeded rows, given up rows with ``ERROR``) of a batch. Every row's
    outcome is written once and read by all that follows, so an attempt that
    answers differently when repeated cannot count a row twice; the ledger has
    (key, attempts, outcome) per try."""
    spark, todo = rows.sparkSession, with_pending(rows, ledger, number)
    plain = todo.columns
    failed = F.col(ERROR).isNotNull()
    tried = attempt(todo).withColumn(ATTEMPTS, F.col(ATTEMPTS) + 1).withColumn(
        "_outcome", F.when(~failed, "done").when(F.col(ATTEMPTS) > max_retries, "dead").otherwise("retry"))
    path = f"{ledger}/tried/batch_id={number}"
    tried.select(*plain, ERROR, "_outcome").write.mode("overwrite").parquet(path)
    tried = spark.read.parquet(path)
    tried.where("_outcome = 'retry'").select(*plain) \
         .write.mode("overwrite").parquet(_pending_path(ledger, number))
    tried.select(key, F.col(ATTEMPTS).alias("attempts"), F.col("_outcome").alias("outcome")) \
         .write.mode("overwrite").parquet(f"{ledger}/ledger/batch_id={number}")
    done = tried.where("_outcome = 'done'").drop(ATTEMPTS, ERROR, "_outcome")
    return done, tried.where("_outcome = 'dead'").drop(ATTEMPTS, "_outcome")


def drain(spark: SparkSession, ledger: str, run: Callable[[DataFrame, int], None],
          max_retries: int = MAX_RETRIES) -> int:
    """After a stream has ended: batches without messages until nothing is
    pending, at most one a retry. Returns their number."""
    if not _exists(spark, f"{ledger}/pending"):
        return 0
    last = spark.read.parquet(f"{ledger}/ledger").agg(F.max("batch_id")).first()[0]
    for n in range(max_retries + 1):
        pending = spark.read.parquet(_pending_path(ledger, last + n))
        if pending.isEmpty():
            return n
        run(pending.drop(ATTEMPTS).limit(0), last + n + 1)
    return max_retries + 1
