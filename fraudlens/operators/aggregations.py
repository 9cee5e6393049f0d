"""Group statistics and report aggregates.

All aggregates are declarative ``groupBy().agg()`` calls so Spark runs a
partial (map-side) aggregate before the shuffle; a hot card or product therefore
costs one partial row per task, not one task per key. Statistic tables are
joined back with plain equi-joins and AQE chooses broadcast from runtime sizes.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fraudlens.operators.rank import grouped_quantiles
from fraudlens.session import join_small

AMT = "TransactionAmt"
EPS = 1e-8


def grouped_median(df: DataFrame, key: str, value: str, out: str = "median") -> DataFrame:
    """Exact per-group median without holding a group in one task."""
    known = df.where(F.col(key).isNotNull())
    return grouped_quantiles(known, (key,), value, [0.5]).withColumnRenamed("q0", out)


def _join_groups(left: DataFrame, right: DataFrame, label: str) -> DataFrame:
    """Joins two tables of one row per group, a null group included."""
    r = right.withColumnRenamed(label, "_label")
    return left.join(r, F.col(label).eqNullSafe(F.col("_label")), "left").drop("_label")


# A01 ------------------------------------------------------------------------
def card_stats(df: DataFrame, key: str = "card1", amt: str = AMT,
               median: str = "distributed") -> DataFrame:
    """median: "distributed" (exact, skew-safe, see grouped_median) or "none"
    (not computed, for consumers that only read the moments)."""
    a = F.col(amt)
    aggs = [F.count(a).alias(f"{key}_card_txn_count"),
            F.avg(a).alias(f"{key}_card_amt_mean"),
            F.stddev_samp(a).alias(f"{key}_card_amt_std"),
            F.min(a).alias(f"{key}_card_amt_min"),
            F.max(a).alias(f"{key}_card_amt_max")]
    stats = df.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)
    if median == "distributed":
        med = grouped_median(df, key, amt, f"{key}_card_amt_median")
        stats = stats.join(med, key, "left")
    return stats


# J02 + A02 ------------------------------------------------------------------
def no_card_stats(spark, key: str = "card1") -> DataFrame:
    """The statistics table of ``card_stats`` (without median) with no cards."""
    own = f"{key} long, {key}_card_txn_count long"
    return spark.createDataFrame([], own + "".join(
        f", {key}_card_amt_{c} double" for c in ("mean", "std", "min", "max")))


def with_card_aggregations(df: DataFrame, key: str = "card1", amt: str = AMT,
                           stats: DataFrame | None = None,
                           median: str = "distributed") -> DataFrame:
    if key not in df.columns:
        return df
    stats = stats if stats is not None else card_stats(df, key, amt, median)
    j = df.join(stats, key, "left")
    std = F.coalesce(F.col(f"{key}_card_amt_std"), F.lit(0.0))
    return (j.withColumn(f"{key}_card_amt_std", std)
             .withColumn("card_amt_zscore",
                         (F.col(amt) - F.col(f"{key}_card_amt_mean")) / (std + EPS))
             .withColumn("card_amt_vs_max",
                         F.col(amt) / (F.col(f"{key}_card_amt_max") + EPS)))


# A03 ------------------------------------------------------------------------
def product_stats(df: DataFrame, key: str = "ProductCD", amt: str = AMT,
                  label: str = "isFraud") -> DataFrame:
    rate = F.avg(label) if label in df.columns else F.lit(0.0)
    return (df.where(F.col(key).isNotNull())
              .groupBy(key)
              .agg(F.count(F.col(amt)).alias("prod_txn_count"),
                   F.avg(amt).alias("prod_amt_mean"),
                   rate.cast("double").alias("prod_fraud_rate")))


# J03
def with_product_aggregations(df: DataFrame, key: str = "ProductCD",
                              stats: DataFrame | None = None) -> DataFrame:
    if key not in df.columns:
        return df
    stats = stats if stats is not None else product_stats(df, key)
    out = [*df.columns, *[c for c in stats.columns if c != key]]
    return join_small(df, stats, [key]).select(*out)


# A04 ------------------------------------------------------------------------
def fraud_rate(df: DataFrame, label: str = "isFraud") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.sum(label).cast("long").alias("n_fraud"),
                  F.avg(label).alias("fraud_rate"))


# A05 ------------------------------------------------------------------------
def missing_fraction(df: DataFrame, top: int = 20) -> DataFrame:
    """One pass: null share of every column, then unpivot, sort, top n."""
    cols = df.columns
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    long = wide.unpivot([], cols, "column_name", "missing_fraction")
    return (long.orderBy(F.desc("missing_fraction"), F.asc("column_name")).limit(top))


# A06 ------------------------------------------------------------------------
def class_counts(df: DataFrame, label: str = "isFraud") -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # The grouped frame has one row per class value: a global window over it
    # is bounded by the number of classes, not by the data.
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.select(F.col(label), "n", (F.col("n") * 100.0 / total).alias("pct"))


# A07 ------------------------------------------------------------------------
def describe_by_class(df: DataFrame, value: str = AMT, label: str = "isFraud") -> DataFrame:
    v = F.col(value)
    moments = df.groupBy(label).agg(F.count(v).alias("count"), F.avg(v).alias("mean"),
                                    F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
                                    F.max(v).alias("max"))
    # both sides have one row per class
    return (_join_groups(moments, grouped_quantiles(df, (label,), value, [0.25, 0.5, 0.75]), label)
            .select(label, "count", "mean", "std", "min", F.col("q0").alias("p25"),
                    F.col("q1").alias("p50"), F.col("q2").alias("p75"), "max"))


# A08 ------------------------------------------------------------------------
def box_summary(df: DataFrame, value: str = AMT, label: str = "isFraud") -> DataFrame:
    v = F.col(value)
    quart = (grouped_quantiles(df, (label,), value, [0.25, 0.5, 0.75])
             .select(label, F.col("q0").alias("q1"), F.col("q1").alias("median"),
                     F.col("q2").alias("q3")))
    quart = quart.withColumn("iqr", F.col("q3") - F.col("q1"))
    lo = F.col("q1") - 1.5 * F.col("iqr")
    hi = F.col("q3") + 1.5 * F.col("iqr")
    j = join_small(df.select(label, value), quart, [label], "inner")
    return (j.groupBy(label, "q1", "median", "q3", "iqr")
              .agg(F.min(F.when(v >= lo, v)).alias("whisker_low"),
                   F.max(F.when(v <= hi, v)).alias("whisker_high"),
                   F.sum(((v < lo) | (v > hi)).cast("long")).alias("n_outliers")))


# A09 ------------------------------------------------------------------------
def equal_width_histogram(df: DataFrame, value: Column | str, n_bins: int,
                          by: str | None = None) -> DataFrame:
    """Equal-width bins over the (per-group) min..max range.

    The range is itself an aggregate joined back on the group key (one row
    per group, AQE-broadcast), so no driver round trip is needed.
    """
    v = F.col(value) if isinstance(value, str) else value
    keys = [by] if by else []
    # with no group key, join on a constant against a broadcast 1-row range
    jkeys = keys or ["_g"]
    base = (df.select(*[F.col(k) for k in keys], v.alias("_v")).where(F.col("_v").isNotNull())
              .withColumn("_g", F.lit(0)))
    rng = base.groupBy(*jkeys).agg(F.min("_v").alias("_mn"), F.max("_v").alias("_mx"))
    rng = rng.select(*jkeys,
                     F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5)
                      .otherwise(F.col("_mn")).alias("lo"),
                     F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5)
                      .otherwise(F.col("_mx")).alias("hi"))
    # the ranges: one row without groups, else as many as a counted check allows
    j = join_small(base, rng, jkeys, "inner") if keys else base.join(F.broadcast(rng), jkeys)
    idx = F.least(F.floor((F.col("_v") - F.col("lo")) * n_bins / (F.col("hi") - F.col("lo"))),
                  F.lit(n_bins - 1)).cast("int")
    out = (j.groupBy(*keys, idx.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n")))
    width = (F.col("hi") - F.col("lo")) / n_bins
    return out.select(*keys, "bin",
                      (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
                      (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
                      "n")


# A10-A12 --------------------------------------------------------------------
def rate_by(df: DataFrame, key: Column | str, name: str | None = None,
            label: str = "isFraud") -> DataFrame:
    k = F.col(key) if isinstance(key, str) else key
    name = name or (key if isinstance(key, str) else "key")
    return (df.groupBy(k.alias(name))
              .agg(F.count(F.lit(1)).alias("n"),
                   F.sum(label).cast("long").alias("n_fraud"),
                   F.avg(label).alias("fraud_rate")))


def top_by_count(df: DataFrame, key: str, n: int = 20, label: str = "isFraud") -> DataFrame:
    return rate_by(df, key, label=label).orderBy(F.desc("n"), F.asc(key)).limit(n)


# A13 / A14 ------------------------------------------------------------------
def decision_counts(decisions: DataFrame, keys=("decision",)) -> DataFrame:
    return decisions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


# A15 ------------------------------------------------------------------------
def rule_hits(decisions: DataFrame, rules_col: str = "triggered_rules") -> DataFrame:
    r = decisions.select(F.explode(rules_col).alias("r"))
    return (r.groupBy(F.col("r.rule_id").alias("rule_id"),
                      F.col("r.category").alias("category"),
                      F.col("r.action").alias("action"))
             .agg(F.count(F.lit(1)).alias("hits")))


# A16 ------------------------------------------------------------------------
# Fixed bucket bounds of the monitoring histograms.
SCORE_BOUNDS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
PREDICTION_LATENCY_BOUNDS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5]
REQUEST_LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]


def _bound_label(b: float) -> str:
    return repr(float(b))


def cumulative_histogram(df: DataFrame, value: str, bounds: list[float],
                         keys: tuple[str, ...] = ()) -> DataFrame:
    """Cumulative ``le`` buckets (+Inf last), sum and count, per group.

    One aggregation pass with a conditional count per bound, then an unpivot;
    the data is never shuffled, only the partial aggregates.
    """
    v = F.col(value)
    aggs = [F.sum((v <= F.lit(b)).cast("long")).alias(f"b{i}") for i, b in enumerate(bounds)]
    aggs += [F.count(v).alias("count"), F.sum(v).alias("sum")]
    wide = df.groupBy(*keys).agg(*aggs)
    stack = F.array(*[F.struct(F.lit(_bound_label(b)).alias("le"),
                               F.lit(float(b)).alias("le_value"),
                               F.col(f"b{i}").alias("cum_count"))
                      for i, b in enumerate(bounds)],
                    F.struct(F.lit("+Inf").alias("le"),
                             F.lit(float("inf")).alias("le_value"),
                             F.col("count").alias("cum_count")))
    return (wide.select(*keys, F.explode(stack).alias("h"), "count", "sum")
                .select(*keys, "h.le", "h.le_value", "h.cum_count", "count", "sum"))


# A17 ------------------------------------------------------------------------
def pivot_metrics(long_metrics: DataFrame, metrics=("roc_auc", "pr_auc", "f1",
                                                     "precision", "recall")) -> DataFrame:
    return (long_metrics.groupBy("model").pivot("metric", list(metrics))
                        .agg(F.first("value")))


# A18 ------------------------------------------------------------------------
def request_counts(req: DataFrame) -> DataFrame:
    return req.groupBy("method", "endpoint", "status_code").agg(F.count(F.lit(1)).alias("n"))


def request_latency_histogram(req: DataFrame) -> DataFrame:
    return cumulative_histogram(req, "latency_s", REQUEST_LATENCY_BOUNDS,
                                keys=("method", "endpoint"))
