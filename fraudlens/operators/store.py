"""Result tables and their maintenance.

The relational store becomes Parquet tables derived from the decided frame.
Updates are expressed as joins producing a new table version (write it with
``overwrite`` to a new path); uniqueness is enforced with an anti join.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudlens.operators import aggregations as A

ALERT_TYPE_BLOCK = "FRAUD_BLOCKED"
UNKNOWN = "UNKNOWN"


# S10 ------------------------------------------------------------------------
def transactions_table(decided: DataFrame, raw_cols: list[str] | None = None) -> DataFrame:
    raw_cols = raw_cols or [c for c in ("TransactionDT", "TransactionAmt", "ProductCD", "card1")
                            if c in decided.columns]
    return decided.select(
        F.col("TransactionID").cast("string").alias("transaction_id"),
        "TransactionDT", "TransactionAmt", "ProductCD", "card1",
        F.to_json(F.struct(*raw_cols)).alias("raw_features"))


def predictions_table(decided: DataFrame, model: dict) -> DataFrame:
    return decided.select(
        F.col("TransactionID").cast("string").alias("transaction_id"),
        "fraud_score", "decision", "risk_level",
        F.lit(model["version"]).alias("model_version"), F.lit(model["name"]).alias("model_name"),
        F.lit(float(model["threshold"])).alias("threshold_used"),
        "triggered_rules", "explanation", "TransactionDT")


# U06 ------------------------------------------------------------------------
def audit_table(decided: DataFrame, actor: str = "scoring_job") -> DataFrame:
    after = F.struct("decision", "fraud_score", "risk_level", "rule_action")
    return decided.select(F.lit("prediction").alias("entity_type"),
                          F.col("TransactionID").cast("string").alias("entity_id"),
                          F.lit("create").alias("action"), F.lit(actor).alias("actor"),
                          F.to_json(after).alias("after_state"))


# S08 ------------------------------------------------------------------------
def alerts_table(decided: DataFrame, channel: str = "webhook") -> DataFrame:
    b = decided.where(F.col("decision") == "BLOCK")
    return b.select(F.lit(ALERT_TYPE_BLOCK).alias("alert_type"),
                    F.col("TransactionID").cast("string").alias("transaction_id"),
                    "fraud_score", F.col("explanation").alias("message"),
                    F.col("risk_level").alias("severity"), F.lit(channel).alias("channel"),
                    F.lit(False).alias("delivered"), "TransactionDT")


def alert_message(alerts: DataFrame) -> DataFrame:
    """Stream alert message: {alert_type, transaction_id, fraud_score, message}."""
    return alerts.select(F.col("transaction_id").alias("key"),
                         F.to_json(F.struct("alert_type", "transaction_id", "fraud_score",
                                            "message")).alias("value"))


# U04 ------------------------------------------------------------------------
def mark_delivered(alerts: DataFrame, delivered_ids: DataFrame, key: str = "transaction_id"
                   ) -> DataFrame:
    d = delivered_ids.select(F.col(key).alias("_d")).distinct().withColumn("_hit", F.lit(True))
    # as many acknowledgements as alerts: not broadcast, however small their files look
    j = alerts.join(d.hint("merge"), F.col(key) == F.col("_d"), "left")
    return j.withColumn("delivered", F.col("delivered") | F.coalesce(F.col("_hit"), F.lit(False))) \
            .drop("_d", "_hit")


# U05 ------------------------------------------------------------------------
def insert_unique(existing: DataFrame | None, new: DataFrame, key: str, order: str) -> DataFrame:
    """Keep the first new row per key (by ``order``) that is not stored yet.

    ``min_by`` is a partial aggregate, so a key repeated many times is reduced
    map-side instead of being collected into one task."""
    first = first_per_key(new, key, order)
    if existing is None:
        return first
    fresh = first.join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


BUCKETS = 64


def first_per_key(new: DataFrame, key: str, order: str) -> DataFrame:
    cols = [c for c in new.columns if c != key]
    return (new.groupBy(key)
               .agg(F.min_by(F.struct(*cols), F.struct(F.col(order), *[F.col(c) for c in cols]))
                     .alias("_r"))
               .select(key, "_r.*"))


def unstored(new: DataFrame, table: str, key: str, order: str) -> DataFrame:
    """The first new row per key that the bucketed table does not hold."""
    first, spark = first_per_key(new, key, order), new.sparkSession
    if not spark.catalog.tableExists(table):
        return first
    return first.join(spark.table(table).select(key).hint("merge"), key, "left_anti")


def append_unique(new: DataFrame, table: str, key: str, order: str, path: str,
                  buckets: int = BUCKETS) -> None:
    """S10 / U05 on a table that stays: rows whose key is not stored yet are
    appended to a table bucketed and sorted by key at ``path`` (shared storage).

    Only the new rows are shuffled, into the table's buckets; the stored rows
    are neither moved nor rewritten and only their keys are read. Appending the
    same rows again, as a replayed batch does, adds nothing. One writer at a
    time; choose ``buckets`` for the table's final size."""
    fresh = unstored(new, table, key, order)
    (fresh.repartition(buckets, key).write.format("parquet").mode("append")
          .bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table))


# U02 ------------------------------------------------------------------------
RULE_COLUMNS = ["name", "description", "category", "severity", "action", "enabled"]


def upsert_rules(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """Full outer join on rule_id; supplied fields overwrite, hit_count is
    reset to 0 for every supplied rule (as the sync does)."""
    e = existing.alias("e")
    u = updates.alias("u")
    j = e.join(u, F.col("e.rule_id") == F.col("u.rule_id"), "full_outer")
    sel = [F.coalesce(F.col("u.rule_id"), F.col("e.rule_id")).alias("rule_id")]
    for c in RULE_COLUMNS:
        sel.append(F.coalesce(F.col(f"u.{c}"), F.col(f"e.{c}")).alias(c))
    sel.append(F.when(F.col("u.rule_id").isNotNull(), F.lit(0).cast("long"))
                .otherwise(F.col("e.hit_count")).alias("hit_count"))
    sel.append(F.when(F.col("u.rule_id").isNotNull(), F.lit(None).cast("long"))
                .otherwise(F.col("e.last_triggered")).alias("last_triggered"))
    return j.select(*sel)


def with_hit_columns(rules: DataFrame) -> DataFrame:
    return rules.withColumns({"hit_count": F.lit(0).cast("long"),
                              "last_triggered": F.lit(None).cast("long")})


# U03 ------------------------------------------------------------------------
def increment_hits(rules: DataFrame, decided: DataFrame, ts: str = "TransactionDT") -> DataFrame:
    hits = (decided.select(F.col(ts).alias("_ts"), F.explode("triggered_rules").alias("r"))
                   .groupBy(F.col("r.rule_id").alias("rule_id"))
                   .agg(F.count(F.lit(1)).alias("_n"), F.max("_ts").alias("_last")))
    j = rules.join(hits, "rule_id", "left")
    return j.select(*[c for c in rules.columns if c not in ("hit_count", "last_triggered")],
                    (F.col("hit_count") + F.coalesce(F.col("_n"), F.lit(0))).alias("hit_count"),
                    F.greatest(F.col("last_triggered"), F.col("_last")).alias("last_triggered"))


# K01-K07 --------------------------------------------------------------------
def most_recent(df: DataFrame, ts: str, n: int, tie: str) -> DataFrame:
    """orderBy + limit plans as TakeOrderedAndProject: a per-partition top-n,
    then a merge of n rows per partition."""
    return df.orderBy(F.desc(ts), F.desc(tie)).limit(n)


def oldest_first(df: DataFrame, ts: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.asc(ts), F.asc(tie)).limit(n)


def top_rules_by_hits(decided: DataFrame, n: int = 10) -> DataFrame:
    return A.rule_hits(decided).orderBy(F.desc("hits"), F.asc("rule_id")).limit(n)


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


# K09 ------------------------------------------------------------------------
def decision_detail(predictions: DataFrame) -> DataFrame:
    """Stored decision with defaults: risk UNKNOWN, empty rules / text."""
    return predictions.select(
        "transaction_id", "fraud_score", "decision",
        F.coalesce(F.col("risk_level"), F.lit(UNKNOWN)).alias("risk_level"),
        F.coalesce(F.col("triggered_rules"),
                   F.array().cast(predictions.schema["triggered_rules"].dataType))
         .alias("triggered_rules"),
        F.coalesce(F.col("explanation"), F.lit("")).alias("explanation"),
        F.col("model_version"))
