"""Sources and sinks (S01-S09, S11, S13): explicit-schema CSV scans, Parquet
split writes, JSON message encode / decode, message envelopes, dead-letter
routing and table replay. Everything is a DataFrame transformation; paths go
through the Hadoop file system so they work on shared storage."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudlens.operators import validation as VAL

# Core transaction columns of the CSV export (extra columns are allowed).
TRANSACTION_SCHEMA = T.StructType([
    T.StructField("TransactionID", T.LongType()),
    T.StructField("TransactionDT", T.LongType()),
    T.StructField("TransactionAmt", T.DoubleType()),
    T.StructField("ProductCD", T.StringType()),
    T.StructField("card1", T.LongType()),
    T.StructField("card4", T.StringType()),
    T.StructField("card6", T.StringType()),
    T.StructField("addr1", T.DoubleType()),
    T.StructField("addr2", T.DoubleType()),
    T.StructField("isFraud", T.IntegerType()),
])
CORRUPT = "_corrupt_record"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


# S01 / S02 --------------------------------------------------------------------
def read_transactions_csv(spark: SparkSession, path: str,
                          schema: T.StructType = TRANSACTION_SCHEMA) -> DataFrame:
    if not path_exists(spark, path):
        raise FileNotFoundError(f"transaction file not found: {path}")
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_optional_csv(spark: SparkSession, path: str, schema: T.StructType | None = None
                      ) -> DataFrame | None:
    if not path_exists(spark, path):
        return None
    r = spark.read.option("header", True)
    return (r.schema(schema) if schema is not None else r.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


# S03 ------------------------------------------------------------------------
def write_splits(train: DataFrame, val: DataFrame, out_dir: str) -> dict[str, str]:
    paths = {"train": f"{out_dir.rstrip('/')}/train", "val": f"{out_dir.rstrip('/')}/val"}
    train.write.mode("overwrite").parquet(paths["train"])
    val.write.mode("overwrite").parquet(paths["val"])
    return paths


# S05 ------------------------------------------------------------------------
def encode_json(df: DataFrame, cols: list[str] | None = None, out: str = "value") -> DataFrame:
    """Keys kept, timestamps as ISO text, nulls omitted (to_json default)."""
    cols = cols or df.columns
    return df.select(*[c for c in df.columns if c not in cols],
                     F.to_json(F.struct(*cols),
                               {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias(out))


def decode_json(df: DataFrame, schema: T.StructType, col: str = "value",
                out: str = "msg") -> DataFrame:
    """Permissive parse; a malformed message keeps its text in _corrupt_record."""
    sch = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(F.col(col), sch, {"mode": "PERMISSIVE",
                                           "columnNameOfCorruptRecord": CORRUPT})
    return df.withColumn(out, parsed)


# S07 ------------------------------------------------------------------------
def envelope(df: DataFrame, key: str | None = None, value: str = "value") -> DataFrame:
    """Message id and produced-at time when absent; a random key when none."""
    k = F.coalesce(F.col(key).cast("string"), F.expr("uuid()")) if key else F.expr("uuid()")
    mid = F.coalesce(F.col("message_id"), F.expr("uuid()")) if "message_id" in df.columns \
        else F.expr("uuid()")
    at = F.coalesce(F.col("produced_at"), F.current_timestamp()) if "produced_at" in df.columns \
        else F.current_timestamp()
    return df.select(k.alias("key"), F.col(value).alias("value"), mid.alias("message_id"),
                     at.alias("produced_at"))


# S09 / T02 --------------------------------------------------------------------
def route_messages(raw: DataFrame, schema: T.StructType, topic: str, value: str = "value"
                   ) -> tuple[DataFrame, DataFrame]:
    """(valid transactions, dead letters). Malformed JSON and rows failing
    validation go to the dead-letter frame with a reason. A message is parsed
    once: filters do not move below the generator, as they would below a
    projection, parsing anew for every field that they test."""
    d = decode_json(raw, schema, value).withColumn("msg", F.explode(F.array("msg")))
    malformed = F.col(f"msg.{CORRUPT}").isNotNull() | F.col("msg").isNull()
    flat = d.select(F.col(value).alias("_raw"), malformed.alias("_bad"),
                    *[F.col(f"msg.{f.name}").alias(f.name) for f in schema.fields])
    v = flat.withColumn("violations", VAL.violations(flat.drop("_raw", "_bad")))
    ok = (~F.col("_bad")) & (F.size("violations") == 0)
    good = v.where(ok).drop("_raw", "_bad", "violations")
    reason = F.when(F.col("_bad"), F.lit("malformed_json")).otherwise(
        F.concat(F.lit("invalid: "), F.array_join("violations", ",")))
    dead = v.where(~ok).select(F.lit(topic).alias("original_topic"),
                               F.col("_raw").alias("original_value"),
                               reason.alias("failure_reason"),
                               F.current_timestamp().alias("failed_at"))
    return good, dead


# S11 ------------------------------------------------------------------------
def replay(df: DataFrame, id_col: str = "TransactionID", order: str = "TransactionDT",
           fraud_only: bool = False, max_records: int | None = None,
           label: str = "isFraud", source: str = "replay") -> DataFrame:
    """Rows to replay as keyed JSON messages with a 0-based replay index."""
    from fraudlens.operators.rank import global_index
    src = df.where(F.col(label) == 1) if fraud_only else df
    if max_records is not None:
        src = src.orderBy(order, id_col).limit(max_records)
    idx = global_index(src, order, id_col, "_replay_index")
    payload = [c for c in df.columns]
    return idx.select(F.col(id_col).cast("string").alias("key"), "_replay_index",
                      F.lit(source).alias("_source"),
                      F.to_json(F.struct(*payload, "_replay_index",
                                         F.lit(source).alias("_source"))).alias("value"))
