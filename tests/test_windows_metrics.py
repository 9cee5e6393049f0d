"""Bucketed (skew-tolerant) windows equal the plain windows; metrics equal
brute-force definitions; global order helpers equal sorting."""
import numpy as np
from pyspark.sql import functions as F

from conftest import SF_MED
from fraudlens.operators import metrics as M
from fraudlens.operators import rank as RK
from fraudlens.operators import windows as W
from fraudlens.sources import views as V


def _rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_sequence_bucketed_equals_direct(spark):
    t = V.txn_orders(spark, SF_MED)
    cols = ["TransactionID", "card_txn_rank", "card_prev_dt", "time_since_last_txn",
            "rapid_succession"]
    a = W.sequence_features(t, strategy="bucketed", bucket_seconds=86400 * 30)
    b = W.sequence_features(t, strategy="direct")
    assert _rows(a, cols) == _rows(b, cols)


def test_velocity_and_avg_bucketed_equal_direct(spark):
    t = V.txn_events(spark, SF_MED)
    names = ["TransactionID", *W.VELOCITY_WINDOWS, *W.FAILED_WINDOWS]
    assert _rows(W.velocity_counts(t), names) == \
        _rows(W.velocity_counts(t, strategy="direct"), names)
    a = W.amount_vs_avg(t, bucket_seconds=3600)
    b = W.amount_vs_avg(t, strategy="direct")
    ra = {r[0]: r[1] for r in a.select("TransactionID", "amount_vs_avg_ratio").collect()}
    rb = {r[0]: r[1] for r in b.select("TransactionID", "amount_vs_avg_ratio").collect()}
    assert ra.keys() == rb.keys()
    assert all(abs(ra[k] - rb[k]) < 1e-9 for k in ra)


def test_geo_bucketed_equals_direct(spark):
    loc = V.locations(spark, SF_MED)
    cards = V.card_countries(spark, SF_MED)
    cols = ["TransactionID", "country_mismatch", "first_international", "impossible_travel"]
    assert _rows(W.geo_features(loc, cards), cols) == \
        _rows(W.geo_features(loc, cards, strategy="direct"), cols)


def test_velocity_burst_fires(spark):
    rows = [(i, 1000 + 5 * i, 7, False) for i in range(7)] + [(100, 5000, 8, True)]
    df = spark.createDataFrame(rows, "TransactionID long, TransactionDT long, card1 long, "
                                     "failed boolean")
    v = {r["TransactionID"]: r for r in W.velocity_counts(df).collect()}
    assert v[6]["card_txn_count_1min"] == 7 and v[0]["card_txn_count_1min"] == 1
    assert v[100]["failed_txn_count_30min"] == 1


def _brute(y, p):
    y, p = np.asarray(y), np.asarray(p)
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    ap = 0.0
    prev_r = 0.0
    for s in sorted(set(p), reverse=True):
        pred = p >= s
        tp = np.sum(pred & (y == 1))
        prec = tp / np.sum(pred)
        r = tp / np.sum(y == 1)
        ap += (r - prev_r) * prec
        prev_r = r
    best, thr = 0.0, 0.5
    for t in np.linspace(0.1, 0.9, 81):
        pred = p >= t
        tp = np.sum(pred & (y == 1)); fp = np.sum(pred & (y == 0)); fn = np.sum(~pred & (y == 1))
        f1 = 0.0 if tp == 0 else 2 * tp / (2 * tp + fp + fn)
        if f1 > best:
            best, thr = f1, t
    return auc, ap, best, thr


def test_metrics_match_brute_force(spark):
    rng = np.random.default_rng(42)
    y = (rng.random(300) < 0.1).astype(int)
    p = np.round(np.clip(rng.random(300) * 0.6 + y * 0.3, 0, 1), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    row = M.metric_row(df).first()
    auc, ap, f1, thr = _brute(y, p)
    assert abs(row["roc_auc"] - auc) < 1e-12
    assert abs(row["pr_auc"] - ap) < 1e-12
    assert abs(row["f1"] - f1) < 1e-12 and abs(row["optimal_threshold"] - thr) < 1e-12


def test_perfect_classifier(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9), (1, 1.0)],
                               "y int, p double")
    row = M.metric_row(df).first()
    assert row["roc_auc"] == 1.0 and row["pr_auc"] == 1.0 and row["f1"] == 1.0


def test_f1_never_positive_defaults(spark):
    df = spark.createDataFrame([(0, 0.95), (0, 0.2), (1, 0.05)], "y int, p double")
    row = M.f1_optimal(df).first()
    assert row["f1"] == 0.0 and row["optimal_threshold"] == 0.5


def test_kth_and_time_split(spark):
    t = V.txn_orders(spark, SF_MED).select("TransactionID", "TransactionDT")
    rows = sorted((r[1], r[0]) for r in t.collect())
    for k in (1, 777, len(rows)):
        v, below = RK.kth_smallest(t, "TransactionDT", k)
        assert v == rows[k - 1][0]
        assert below == sum(1 for r in rows if r[0] < v)
    tr, va = RK.time_split(t, 0.2)
    cut = int(len(rows) * 0.8)
    assert sorted(r[0] for r in tr.collect()) == sorted(r[1] for r in rows[:cut])
    assert va.count() == len(rows) - cut


def test_selection_with_outliers_and_large_ids(spark):
    values = [10.0 ** e for e in range(-300, 301)]
    df = spark.createDataFrame([(v,) for v in reversed(values)], "x double")
    assert RK.kth_smallest(df, "x", 50) == (values[49], 49)
    big = spark.createDataFrame([(2 ** 60 + i, 5) for i in range(10)],
                                "TransactionID long, TransactionDT long")
    tr, va = RK.time_split(big, 0.2)
    assert sorted(r[0] for r in tr.collect()) == [2 ** 60 + i for i in range(8)]
    assert va.count() == 2


def test_range_partitions_are_even_under_an_outlier(spark):
    """200,000 scores near zero and one far away: no partition has twice the mean."""
    df = spark.range(200_000).select((F.col("id") % 1999 / 1e7 + F.col("id") / 1e12).alias("x")) \
              .union(spark.range(1).select(F.lit(0.99)))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in RK._ranged(df, "x").groupBy("_part").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert len(sizes) == 8 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_quantiles_equal_percentile(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 11 > 0, F.col("id") % 2).alias("g"),
                                  F.when(F.col("id") % 5 > 0, (F.col("id") * 37) % 1013 / 7.0).alias("v"))
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    want = {r[0]: r[1] for r in df.groupBy("g").agg(
        F.percentile("v", F.array(*[F.lit(p) for p in probs]))).collect()}
    for r in RK.grouped_quantiles(df, ("g",), "v", probs).collect():
        assert all(abs(a - b) < 1e-9 for a, b in zip(r[1:], want[r["g"]]))


def test_global_index(spark):
    t = V.txn_events(spark, SF_MED).select("TransactionID", "TransactionDT")
    got = {r["TransactionID"]: r["_index"]
           for r in RK.global_index(t, "TransactionDT", "TransactionID").collect()}
    exp = {r[1]: i for i, r in enumerate(sorted((r[1], r[0]) for r in t.collect()))}
    assert got == exp


def test_card_windows_single_shuffle_equals_direct(spark):
    t = V.txn_events(spark, SF_MED).withColumns(V.location_columns())
    cards = V.card_countries(spark, SF_MED)
    one = W.card_windows(t, cards, bucket_seconds=3600)
    two = W.velocity_counts(W.sequence_and_geo(t, cards, strategy="direct"), strategy="direct")
    cols = ["TransactionID", "card_txn_rank", "card_prev_dt", "rapid_succession",
            "country_mismatch", "first_international", "impossible_travel",
            *W.VELOCITY_WINDOWS, *W.FAILED_WINDOWS]
    assert _rows(one, cols) == _rows(two, cols)


def test_hot_card_is_split_and_exact(spark):
    """A card holding a third of all rows: the bucketed plans still equal the
    plain windows, and the card's rows spread over many (card, bucket) keys."""
    t = V.txn_events(spark, SF_MED).withColumn(
        "card1", F.when(F.col("TransactionID") % 3 == 0, F.lit(1)).otherwise(F.col("card1")))
    t = t.withColumns(V.location_columns())
    cards = t.select("card1", "home_country").groupBy("card1").agg(
        F.min("home_country").alias("home_country"))
    one = W.card_windows(t, cards, bucket_seconds=3600)
    two = W.velocity_counts(W.sequence_and_geo(t, cards, strategy="direct"), strategy="direct")
    cols = ["TransactionID", "card_txn_rank", "card_prev_dt", "first_international",
            "impossible_travel", *W.VELOCITY_WINDOWS, *W.FAILED_WINDOWS]
    assert _rows(one, cols) == _rows(two, cols)
    hot_buckets = t.where("card1 = 1").select(F.floor(F.col("TransactionDT") / 3600)).distinct()
    assert hot_buckets.count() > 100
    a = W.amount_vs_avg(t, bucket_seconds=86400)
    b = W.amount_vs_avg(t, strategy="direct")
    ra = dict(a.select("TransactionID", "amount_vs_avg_ratio").collect())
    rb = dict(b.select("TransactionID", "amount_vs_avg_ratio").collect())
    assert all(abs(ra[k] - rb[k]) < 1e-9 for k in rb)


def test_grouped_median_exact(spark):
    from fraudlens.operators import aggregations as A
    t = V.txn_orders(spark, SF_MED).withColumn(
        "card1", F.when(F.col("TransactionID") % 3 == 0, F.lit(1)).otherwise(F.col("card1")))
    got = dict(A.grouped_median(t, "card1", "TransactionAmt").collect())
    exp = dict(t.groupBy("card1").agg(F.median("TransactionAmt")).collect())
    assert got.keys() == exp.keys()
    assert all(abs(got[k] - exp[k]) <= 1e-9 * max(1.0, abs(exp[k])) for k in exp)
