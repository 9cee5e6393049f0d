"""Feature pipeline checks in the spirit of SURVEY section 5: ranges, binary
flags, no nulls after the fill, split sizes and time order, alignment."""
from pyspark.sql import functions as F

from conftest import SF_MED, SF_SMALL
from fraudlens.operators import pipeline as P
from fraudlens.operators import rank as RK
from fraudlens.sources import views as V

BINARY = ["is_weekend", "is_night", "is_round_amount", "P_email_suspicious",
          "R_email_suspicious", "P_email_same_as_R", "rapid_succession"]


def test_feature_matrix_ranges_and_no_nulls(spark):
    df = P.merge_identity(V.txn_events(spark, SF_SMALL), V.identity(spark, SF_SMALL))
    X, cols = P.build_feature_matrix(df)
    assert "TransactionID" not in cols and "isFraud" not in cols and "card_prev_dt" not in cols
    nulls = X.select(*[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in cols]).first()
    assert all(v == 0 for v in nulls.asDict().values())
    r = X.agg(*[F.min(c).alias(f"mn_{c}") for c in BINARY + ["hour", "day_of_week", "month"]],
              *[F.max(c).alias(f"mx_{c}") for c in BINARY + ["hour", "day_of_week", "month"]]
              ).first()
    for c in BINARY:
        assert r[f"mn_{c}"] >= 0 and r[f"mx_{c}"] <= 1
    assert 0 <= r["mn_hour"] and r["mx_hour"] <= 23
    assert 0 <= r["mn_day_of_week"] and r["mx_day_of_week"] <= 6
    assert 1 <= r["mn_month"] and r["mx_month"] <= 12
    codes = X.agg(F.min("ProductCD"), F.max("ProductCD")).first()
    assert codes[0] >= 0


def test_unknown_categories_and_train_only_statistics(spark):
    t = V.txn_orders(spark, SF_MED)
    train, val = RK.time_split(t, 0.2)
    st = P.FeatureStats.fit(train)
    Xv = st.transform(val)
    assert Xv.count() == val.count()
    assert set(st.feature_cols) <= set(Xv.columns)
    # a category never seen in training encodes to -1
    odd = val.limit(3).withColumn("card4", F.lit("NEVER-SEEN"))
    assert {r[0] for r in st.transform(odd).select("card4").collect()} == {-1}


def test_time_split_sizes_and_order(spark):
    t = V.txn_orders(spark, SF_MED)
    n = t.count()
    train, val = RK.time_split(t, 0.2)
    assert train.count() == int(n * 0.8) and val.count() == n - int(n * 0.8)
    last = train.agg(F.max(F.struct("TransactionDT", "TransactionID"))).first()[0]
    first = val.agg(F.min(F.struct("TransactionDT", "TransactionID"))).first()[0]
    assert tuple(last) < tuple(first)


def test_alignment_fills_missing_and_drops_extras(spark):
    df = spark.createDataFrame([(1, 2.0, 9.0)], "TransactionID long, a double, extra double")
    out = P.align_features(df, ["a", "b"], keep=("TransactionID",))
    assert out.columns == ["TransactionID", "a", "b"]
    assert out.first()["b"] == 0.0


def test_category_codes_spread_over_partitions(spark):
    from pyspark.sql.window import Window
    t = V.txn_orders(spark, SF_MED).withColumn("card4", F.concat("card4", F.col("card1") % 97))
    got = {(r[0], r[1]): r[2] for r in
           P.fit_category_codes(t, ["card4", "ProductCD"], n_parts=16).collect()}
    d = t.select(F.lit("card4").alias("column"), F.col("card4").alias("value")).union(
        t.select(F.lit("ProductCD"), F.col("ProductCD"))).distinct()
    exp = {(r[0], r[1]): r[2] for r in d.withColumn(
        "code", F.row_number().over(Window.partitionBy("column").orderBy("value")) - 1).collect()}
    assert got == exp


def test_fill_medians(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0), (4, 10.0)], "i long, x double")
    medians = P.fit_medians(df, ["x"])
    assert medians == {"x": 3.0}
    assert P.fill_medians(df, medians).where("i = 2").first()["x"] == 3.0


def test_medians_of_many_columns_are_exact(spark):
    cols = [f"c{i}" for i in range(80)]
    df = spark.range(101).select(*[
        F.when((F.col("id") + i) % 7 > 0, (F.col("id") * (i + 1)) % 97 / 3.0).alias(c)
        for i, c in enumerate(cols)])
    want = df.agg(*[F.median(c).alias(c) for c in cols]).first().asDict()
    got = P.fit_medians(df, cols)
    assert all(abs(got[c] - want[c]) < 1e-12 for c in cols)
