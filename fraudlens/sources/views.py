"""Transaction-shaped views over the driver tables.

Every view is a lazy projection of the parquet scans, so Catalyst prunes the
columns a query does not use and pushes filters into the scan.

``txn_events``  events   -> second-level times; velocity, streaming, monitoring.
``txn_orders``  orders + customer + nation -> wide amounts, day-granular ties.
``identity``    labels   -> the optional second table of a left join.
``requests``    events   -> request log for latency / status metrics.
``offsets``     events   -> per topic-partition end and committed offsets.
``locations``   events   -> coordinates and countries for geography rules.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudlens.session import table_path

# ---------------------------------------------------------------------------
# Fixed values shared with the SQL oracle (plans/oracles.py builds the same
# views from these constants).
# ---------------------------------------------------------------------------
EVENTS_EPOCH = 1704067200      # 2024-01-01 00:00:00 UTC
ORDERS_EPOCH = 788918400       # 1995-01-01 00:00:00 UTC
EMAIL_DOMAINS = [
    "gmail.com",
    "yahoo.com",
    "hotmail.co.uk",
    "mailinator.com",
    "outlook.com",
    "anonymous",
    "yopmail.com",
]
FRAUD_MOD_EVENTS = 20          # isFraud = C1 % 20 = 0
FRAUD_MOD_ORDERS = 29          # isFraud = o_orderkey % 29 = 0
N_COUNTRIES = 25


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def _pick(values: list[str], idx: Column) -> Column:
    """values[idx] for a 0-based integer column (JVM-side, no UDF)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a (possibly NTZ) timestamp, floored."""
    return F.unix_seconds(ts.cast("timestamp"))


def txn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events")
    c1 = F.get_json_object("props", "$.k").cast("long")
    user = F.col("user_id")
    return ev.select(
        F.col("event_id").alias("TransactionID"),
        (epoch_seconds(F.col("ts")) - F.lit(EVENTS_EPOCH)).alias("TransactionDT"),
        F.col("value").alias("TransactionAmt"),
        F.col("event_type").alias("ProductCD"),
        user.alias("card1"),
        c1.alias("C1"),
        (F.col("event_type") == "error").alias("failed"),
        _pick(EMAIL_DOMAINS, user % len(EMAIL_DOMAINS)).alias("P_emaildomain"),
        F.when(user % 3 == 0, F.lit(None).cast("string"))
         .otherwise(_pick(EMAIL_DOMAINS, F.floor(user / 2) % len(EMAIL_DOMAINS)))
         .alias("R_emaildomain"),
        (c1 % FRAUD_MOD_EVENTS == 0).cast("int").alias("isFraud"),
    )


def txn_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    # nation is a fixed 25-row dimension: broadcasting it is size-bounded.
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    j = (o.join(c, o.o_custkey == c.c_custkey, "left")
          .join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left"))
    return j.select(
        F.col("o_orderkey").alias("TransactionID"),
        (epoch_seconds(F.col("o_orderdate")) - F.lit(ORDERS_EPOCH)).alias("TransactionDT"),
        F.col("o_totalprice").alias("TransactionAmt"),
        F.substring("o_orderpriority", 1, 1).alias("ProductCD"),
        F.col("o_custkey").alias("card1"),
        F.col("c_mktsegment").alias("card4"),
        F.col("o_orderstatus").alias("card6"),
        F.col("c_nationkey").cast("double").alias("addr1"),
        F.col("n_regionkey").cast("double").alias("addr2"),
        (F.col("o_orderkey") % FRAUD_MOD_ORDERS == 0).cast("int").alias("isFraud"),
    )


def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lb = read(spark, sf_dir, "labels")
    return lb.select(
        F.col("doc_id").alias("TransactionID"),
        F.col("quality").cast("double").alias("id_01"),
        F.col("toxic").cast("double").alias("id_02"),
        F.when(F.col("toxic") == 1, "new").otherwise("known").alias("DeviceType"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.lit("POST").alias("method"),
        F.col("event_type").alias("endpoint"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
        (F.col("value") / 100).alias("latency_s"),
    )


def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (topic, partition): end offset and committed offset."""
    ev = read(spark, sf_dir, "events")
    c1 = F.get_json_object("props", "$.k").cast("long")
    return (ev.select(F.col("event_type").alias("topic"),
                      (F.col("user_id") % 3).cast("int").alias("partition"),
                      F.col("event_id"), c1.alias("C1"))
              .groupBy("topic", "partition")
              .agg(F.max("event_id").alias("end_offset"),
                   F.max(F.when(F.col("C1") < 90, F.col("event_id"))).alias("committed_offset")))


def location_columns() -> dict[str, Column]:
    """Coordinates, card home country and transaction country of an event row."""
    home = (F.col("card1") % N_COUNTRIES).cast("int")
    abroad = F.col("TransactionID") % 10 == 0
    return {
        "lat": ((F.col("card1") * 37) % 120 - 60 + (F.col("C1") % 10) * 0.01).cast("double"),
        "lon": ((F.col("card1") * 53) % 300 - 150 + F.when(abroad, 25).otherwise(0)
                + (F.col("C1") % 7) * 0.01).cast("double"),
        "home_country": home,
        "txn_country": F.when(F.col("TransactionID") % 10 == 0, (home + 1) % N_COUNTRIES)
                        .otherwise(home).cast("int"),
    }


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per transaction: coordinates, card home country and transaction country."""
    t = txn_events(spark, sf_dir)
    return t.select("TransactionID", "TransactionDT", "card1",
                    *[c.alias(n) for n, c in location_columns().items()])


def card_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card -> issuing (home) country, one row per card."""
    return locations(spark, sf_dir).select("card1", "home_country").distinct()
