"""Model-evaluation tables.

Everything starts from a per-score aggregate (positives / negatives per
distinct score), so the data is reduced map-side before any ordering; the
ordered part (prefix sums over scores) uses ``rank.prefix_sums`` instead of a
global window.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fraudlens.operators.rank import prefix_sums
from fraudlens.session import join_small

# Fixed grids (numpy.linspace values, written out by rule at import).
F1_THRESHOLDS = [float(x) for x in np.linspace(0.1, 0.9, 81)]
CALIBRATION_EDGES = [float(x) for x in np.linspace(0.0, 1.0, 11)]
DENSITY_EDGES = [float(x) for x in np.linspace(0.0, 1.0, 51)]
DEFAULT_F1_THRESHOLD = 0.5
POSITIVE_CLASS_WEIGHT = 10.0


def score_counts(df: DataFrame, y: str = "y", p: str = "p", keys: tuple[str, ...] = ()
                 ) -> DataFrame:
    yy = F.col(y).cast("long")
    return (df.groupBy(*keys, F.col(p).alias("p"))
              .agg(F.sum(yy).alias("pos"), F.sum(1 - yy).alias("neg")))


def _with_cum(df: DataFrame, y: str, p: str, keys: tuple[str, ...]) -> DataFrame:
    """Per distinct score: pos, neg, and counts strictly above / below it."""
    # one row per distinct score, written once by the range step
    asc = prefix_sums(score_counts(df, y, p, keys), "p", ["pos", "neg"], keys)
    tot = asc.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    if keys:
        j = asc.join(tot, list(keys), "left")
    else:   # one-row totals: broadcast hash join on a constant key
        j = asc.withColumn("_g", F.lit(0)).join(
            F.broadcast(tot.withColumn("_g", F.lit(0))), "_g").drop("_g")
    # TP(s) / FP(s): predicted positive at threshold s means score >= s
    return j.withColumns({
        "tp": F.col("n_pos") - F.col("pos_before"),
        "fp": F.col("n_neg") - F.col("neg_before"),
    })


# M08 ------------------------------------------------------------------------
def roc_auc(df: DataFrame, y: str = "y", p: str = "p", keys: tuple[str, ...] = ()) -> DataFrame:
    """Mann-Whitney with ties counted half; integer numerator, one division."""
    c = _with_cum(df, y, p, keys)
    num = F.sum(2 * F.col("pos") * F.col("neg_before") + F.col("pos") * F.col("neg"))
    return (c.groupBy(*keys).agg(num.alias("_num"), F.first("n_pos").alias("n_pos"),
                                 F.first("n_neg").alias("n_neg"))
             .select(*keys, (F.col("_num") / (2.0 * F.col("n_pos") * F.col("n_neg"))).alias("roc_auc")))


# M09 ------------------------------------------------------------------------
def average_precision(df: DataFrame, y: str = "y", p: str = "p", keys: tuple[str, ...] = ()
                      ) -> DataFrame:
    """sum over distinct scores (descending) of (R_n - R_n-1) * P_n."""
    c = _with_cum(df, y, p, keys)
    term = F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return (c.groupBy(*keys).agg(F.sum(term).alias("_s"), F.first("n_pos").alias("n_pos"))
             .select(*keys, (F.col("_s") / F.col("n_pos")).alias("pr_auc")))


def curve_metrics(df: DataFrame, y: str = "y", p: str = "p", keys: tuple[str, ...] = ()
                  ) -> DataFrame:
    """(keys, roc_auc, pr_auc) from one table of running counts."""
    c = _with_cum(df, y, p, keys)
    area = F.sum(2 * F.col("pos") * F.col("neg_before") + F.col("pos") * F.col("neg"))
    term = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return (c.groupBy(*keys).agg(area.alias("_a"), term.alias("_s"), F.first("n_pos").alias("n_pos"),
                                 F.first("n_neg").alias("n_neg"))
             .select(*keys, (F.col("_a") / (2.0 * F.col("n_pos") * F.col("n_neg"))).alias("roc_auc"),
                     (F.col("_s") / F.col("n_pos")).alias("pr_auc")))


# M16 / M17 ------------------------------------------------------------------
def roc_points(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    c = _with_cum(df, y, p, ())
    return c.select(F.col("p").alias("threshold"), (F.col("fp") / F.col("n_neg")).alias("fpr"),
                    (F.col("tp") / F.col("n_pos")).alias("tpr"))


def pr_points(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    c = _with_cum(df, y, p, ())
    return c.select(F.col("p").alias("threshold"),
                    (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                    (F.col("tp") / F.col("n_pos")).alias("recall"),
                    (F.col("n_pos") / (F.col("n_pos") + F.col("n_neg"))).alias("base_rate"))


# M10 ------------------------------------------------------------------------
def _count_leq(p: Column, grid: list[float]) -> Column:
    """Number of grid values <= p for an evenly spaced ascending grid: an
    arithmetic guess corrected against the literal grid values."""
    n = len(grid)
    step = (grid[-1] - grid[0]) / (n - 1)
    arr = F.array(*[F.lit(v) for v in grid])
    g = F.least(F.greatest(F.floor((p - grid[0]) / step) + 1, F.lit(0)), F.lit(n)).cast("int")
    g = F.when((g >= 1) & (F.element_at(arr, F.greatest(g, F.lit(1))) > p), g - 1).otherwise(g)
    g = F.when((g < n) & (F.element_at(arr, F.least(g + 1, F.lit(n))) <= p), g + 1).otherwise(g)
    return g


def f1_optimal(df: DataFrame, y: str = "y", p: str = "p", keys: tuple[str, ...] = ()
               ) -> DataFrame:
    """Best F1 over the 81 thresholds, per group; first (lowest) threshold wins
    ties; threshold 0.5 and F1 0 when F1 is never positive; zero division is 0."""
    n = len(F1_THRESHOLDS)
    yy = F.col(y).cast("long")
    counts = (df.groupBy(*keys, _count_leq(F.col(p), F1_THRESHOLDS).alias("g"))
                .agg(F.sum(yy).alias("pos"), F.sum(1 - yy).alias("neg")))
    # a dense 0..n grid of bucket numbers per group: zero rows fill the gaps
    groups = counts.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    grid = groups.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n))).alias("g"),
                         F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"))
    dense = counts.unionByName(grid).groupBy(*keys, "g").agg(F.sum("pos").alias("pos"),
                                                             F.sum("neg").alias("neg"))
    part = list(keys) or [F.lit(0)]                    # n + 1 rows per group
    suffix = Window.partitionBy(*part).orderBy(F.desc("g")).rowsBetween(Window.unboundedPreceding, 0)
    tot = Window.partitionBy(*part)
    t = dense.select(*keys, "g", F.sum("pos").over(suffix).alias("tp"),
                     F.sum("neg").over(suffix).alias("fp"), F.sum("pos").over(tot).alias("n_pos"))
    t = t.where(F.col("g") >= 1)                      # threshold index i = g - 1
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp")
                                                    + (F.col("n_pos") - F.col("tp")))).otherwise(0.0)
    prec = F.when(F.col("tp") + F.col("fp") > 0,
                  F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    rec = F.when(F.col("n_pos") > 0, F.col("tp") / F.col("n_pos")).otherwise(0.0)
    arr = F.array(*[F.lit(v) for v in F1_THRESHOLDS])
    t = t.select(*keys, "g", f1.alias("f1"), prec.alias("precision"), rec.alias("recall"),
                 F.element_at(arr, F.col("g")).alias("threshold"))
    default_g = F1_THRESHOLDS.index(DEFAULT_F1_THRESHOLD) + 1
    best = t.groupBy(*keys).agg(F.max_by(F.struct("f1", "precision", "recall", "threshold"),
                                         F.struct(F.col("f1"), -F.col("g"))).alias("b"),
                                F.max("f1").alias("mf1"),
                                F.max_by(F.struct("precision", "recall"),
                                         (F.col("g") == default_g).cast("int")).alias("d"))
    pos = F.col("mf1") > 0
    return best.select(
        *keys, F.when(pos, F.col("b.f1")).otherwise(0.0).alias("f1"),
        F.when(pos, F.col("b.precision")).otherwise(F.col("d.precision")).alias("precision"),
        F.when(pos, F.col("b.recall")).otherwise(F.col("d.recall")).alias("recall"),
        F.when(pos, F.col("b.threshold")).otherwise(F.lit(DEFAULT_F1_THRESHOLD))
         .alias("optimal_threshold"))


# M18 / M14 ------------------------------------------------------------------
def confusion(df: DataFrame, threshold: float, y: str = "y", p: str = "p") -> DataFrame:
    return (df.groupBy(F.col(y).cast("int").alias("actual"),
                       (F.col(p) >= threshold).cast("int").alias("predicted"))
              .agg(F.count(F.lit(1)).alias("n")))


# M19 ------------------------------------------------------------------------
def calibration(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """10 uniform bins, right-closed: bin = number of interior edges < p."""
    interior = CALIBRATION_EDGES[1:-1]
    b = sum(((F.col(p) > F.lit(e)).cast("int") for e in interior), F.lit(0))
    return (df.groupBy(b.alias("bin"))
              .agg(F.avg(F.col(y).cast("double")).alias("prob_true"),
                   F.avg(p).alias("prob_pred"), F.count(F.lit(1)).alias("n")))


# M20 ------------------------------------------------------------------------
def score_density(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """50 bins on [0, 1] per class; density = count / (n_class * width)."""
    edges = DENSITY_EDGES
    nb = len(edges) - 1
    arr = F.array(*[F.lit(v) for v in edges])
    inside = (F.col(p) >= 0) & (F.col(p) <= 1)
    g = F.least(_count_leq(F.col(p), edges) - 1, F.lit(nb - 1))
    base = df.where(inside).select(F.col(y).cast("int").alias("label"), g.alias("bin"))
    counts = base.groupBy("label", "bin").agg(F.count(F.lit(1)).alias("n"))
    ncls = Window.partitionBy("label")
    width = F.element_at(arr, F.col("bin") + 2) - F.element_at(arr, F.col("bin") + 1)
    return counts.select("label", "bin", "n",
                         (F.col("n") / (F.sum("n").over(ncls) * width)).alias("density"))


# M06 ------------------------------------------------------------------------
def class_weights(df: DataFrame, y: str = "y") -> DataFrame:
    c = df.groupBy(F.col(y).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    tot = Window.partitionBy(F.lit(0))          # one row per class value
    return c.select("label", "n",
                    (F.sum("n").over(tot) / (2.0 * F.col("n"))).alias("balanced_weight"),
                    F.when(F.col("label") == 1, F.lit(POSITIVE_CLASS_WEIGHT))
                     .otherwise(F.lit(1.0)).alias("fixed_weight"))


def weight_column(df: DataFrame, y: str = "y", balanced: bool = True) -> DataFrame:
    w = class_weights(df, y).select(F.col("label").alias("_l"),
                                    F.col("balanced_weight" if balanced else "fixed_weight")
                                     .alias("weight"))
    out = join_small(df.withColumn("_l", F.col(y).cast("int")), w, ["_l"])
    return out.select(*df.columns, "weight")


# Summary / comparison (M08-M11, A17, M25) ------------------------------------
METRIC_NAMES = ("roc_auc", "pr_auc", "f1", "precision", "recall")


def metric_row(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """One row: roc_auc, pr_auc, f1, precision, recall, optimal_threshold."""
    a = curve_metrics(df, y, p).withColumn("_j", F.lit(0))
    c = f1_optimal(df, y, p).withColumn("_j", F.lit(0))
    return a.join(F.broadcast(c), "_j").drop("_j")            # two one-row frames


def metrics_long(scored: DataFrame, models: dict[str, str], y: str = "y") -> DataFrame:
    """(model, metric, value) for several score columns of one frame."""
    parts = []
    for name, col in models.items():
        r = metric_row(scored, y, col)
        parts.append(r.select(F.lit(name).alias("model"), F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
            for m in (*METRIC_NAMES, "optimal_threshold")])).alias("m")))
    out = parts[0]
    for p_ in parts[1:]:
        out = out.unionByName(p_)
    return out.select("model", "m.metric", "m.value")


def best_model(long_metrics: DataFrame, by: str = "pr_auc") -> DataFrame:
    """Model with the highest value of ``by``."""
    return (long_metrics.where(F.col("metric") == by)
                        .agg(F.max_by("model", "value").alias("best_model"),
                             F.max("value").alias(by)))


def metric_history(df: DataFrame, version: str, y: str = "y", p: str = "p") -> DataFrame:
    """The six metrics of every model version and the change of the two
    areas from the version before."""
    h = curve_metrics(df, y, p, (version,)).join(f1_optimal(df, y, p, (version,)), version)
    w = Window.partitionBy(F.lit(0)).orderBy(version)   # one row per version
    return h.withColumns({"roc_auc_delta": F.col("roc_auc") - F.lag("roc_auc").over(w),
                          "pr_auc_delta": F.col("pr_auc") - F.lag("pr_auc").over(w)})
