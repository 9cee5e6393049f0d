"""Composed feature pipeline.

``FeatureStats.fit`` learns everything that depends on the training rows
(per-card and per-product statistics, category codes, fill medians) as small
DataFrames; ``transform`` applies them to any frame with joins, so inference
sees the statistics of the training data instead of one-row aggregates.
"""
from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fraudlens.functions import features as fx
from fraudlens.operators import aggregations as A
from fraudlens.operators import windows as W
from fraudlens.operators.rank import grouped_quantiles, prefix_sums
from fraudlens.session import join_small, materialize

# Fixed category columns of the transaction schema (encoded when present).
CATEGORICAL_COLS = ["ProductCD", "card4", "card6", "P_emaildomain", "R_emaildomain",
                    "M1", "M2", "M3", "M4", "M5", "M6", "M7", "M8", "M9"]
EXCLUDED_FEATURES = {"TransactionID", "isFraud", "card_prev_dt", "addr_combo"}
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType, T.BooleanType)


# J01 ------------------------------------------------------------------------
def merge_identity(txn: DataFrame, idn: DataFrame | None) -> DataFrame:
    return txn if idn is None else txn.join(idn, "TransactionID", "left")


# F01-F10 as one projection ---------------------------------------------------
def row_features(df: DataFrame) -> DataFrame:
    tp = fx.time_parts()
    out = df.withColumns(tp)
    h, d = F.col("hour"), F.col("day_of_week")
    out = out.withColumns({**fx.weekend_night(h, d), **fx.cyclic(h, d)})
    if "TransactionAmt" in out.columns:
        out = out.withColumns(fx.amount_features())
    out = out.withColumns(fx.email_features(out))
    if "addr1" in out.columns and "addr2" in out.columns:
        out = out.withColumns(fx.addr_features())
    return out


# M01 ------------------------------------------------------------------------
def _cat_text(c: str) -> F.Column:
    # pandas astype(str) turns a missing value into the text "nan"
    return F.coalesce(F.col(c).cast("string"), F.lit("nan"))


def fit_category_codes(df: DataFrame, cols: list[str] | None = None,
                       n_parts: int | None = None) -> DataFrame:
    """(column, value, code): sorted distinct values numbered from 0.

    The distinct (column, value) pairs are range-partitioned on (column,
    value), so a column with very many values spreads over many tasks; each
    range partition numbers its rows locally and adds the count of the same
    column's values in earlier partitions (a table of partitions x columns).
    """
    from fraudlens.session import materialize
    cols = [c for c in (cols or CATEGORICAL_COLS) if c in df.columns]
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column string, value string, code int")
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), _cat_text(c).alias("value")) for c in cols]))
        .alias("s")).select("s.column", "s.value").distinct()
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(stacked.repartitionByRange(n, "column", "value")
                                .withColumn("_pid", F.spark_partition_id()))
    counts = ranged.groupBy("_pid", "column").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("column").orderBy("_pid") \
                   .rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("_pid", "column",
                         F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    w = Window.partitionBy("_pid", "column").orderBy("value")
    # offsets: one row per (partition, column), bounded by partitions x columns
    return (ranged.join(F.broadcast(offs), ["_pid", "column"])
                  .select("column", "value",
                          (F.row_number().over(w) - 1 + F.col("_off")).cast("int").alias("code")))


def apply_category_codes(df: DataFrame, codes: DataFrame, cols: list[str] | None = None
                         ) -> DataFrame:
    """Codes of all columns; a column of few values is joined by broadcast
    after its values are counted, one of many by salted keys."""
    cols = [c for c in (cols or CATEGORICAL_COLS) if c in df.columns]
    sizes = {r["column"]: r["n"] for r in
             codes.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = df
    for c in cols:
        m = codes.where(F.col("column") == c).select(F.col("value").alias("_value"),
                                                     F.col("code").alias("_code"))
        out = (join_small(out.withColumn("_value", _cat_text(c)), m, ["_value"],
                          rows=sizes.get(c, 0))
               .withColumn(c, F.coalesce(F.col("_code"), F.lit(-1)).cast("int"))
               .drop("_value", "_code").select(*df.columns))
    return out


# M02 ------------------------------------------------------------------------
def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def fit_medians(df: DataFrame, cols: list[str] | None = None) -> dict:
    """Exact medians of all numeric columns, however many columns and rows
    there are. A sketch of every column gives a narrow range round its middle,
    one pass counts the rows below and inside it, and only the values inside
    are counted per value and ranked in range partitions. A column whose range
    misses the middle is ranked whole. The result is one value per column,
    fetched to the driver and applied as literals."""
    cols = cols or [c for c in numeric_columns(df)
                    if not isinstance(df.schema[c].dataType, T.BooleanType)]
    if not cols:
        return {}
    value = [F.col(c).cast("double") for c in cols]
    near = df.agg(*[F.percentile_approx(v, [0.49, 0.51], 2000).alias(f"b{i}")
                    for i, v in enumerate(value)]).first()          # two values per column
    known = [i for i in range(len(cols)) if near[i] is not None]
    if not known:
        return {}
    counted = df.agg(*[a for i in known for a in (
        F.count(value[i]).alias(f"n{i}"), F.count_if(value[i] < F.lit(near[i][0])).alias(f"below{i}"),
        F.count_if(value[i] <= F.lit(near[i][1])).alias(f"upto{i}"))]).first()
    found, ranked, whole = {}, {}, []
    for i in known:
        n, below, upto = (counted[f"{k}{i}"] for k in ("n", "below", "upto"))
        first, last = (n - 1) // 2, n // 2
        if not below <= first <= last < upto:
            whole.append(i)
        elif near[i][0] == near[i][1]:
            found[cols[i]] = near[i][0] + 0.0
        else:
            ranked[i] = (first - below, last - below)
    if ranked:
        inside = _stacked({i: F.when(value[i].between(*near[i]), value[i]) for i in ranked}, df)
        counts = inside.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
        at = prefix_sums(counts, "v", ["n"], keys=("c",))
        rank = [F.element_at(F.create_map(*[F.lit(x) for i, k in ranked.items() for x in (i, k[side])]),
                             F.col("c")) for side in (0, 1)]
        hit = [F.max(F.when((F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n")), F.col("v")))
               for k in rank]
        for r in at.groupBy("c").agg(hit[0].alias("lo"), hit[1].alias("hi")).collect():    # per column
            same = ranked[r["c"]][0] == ranked[r["c"]][1]
            found[cols[r["c"]]] = r["lo"] if same else 0.5 * r["lo"] + 0.5 * r["hi"]
    if whole:
        rows = grouped_quantiles(_stacked({i: value[i] for i in whole}, df), ("c",), "v", [0.5])
        found.update({cols[r["c"]]: r["q0"] for r in rows.collect()})
    return found


def _stacked(values: dict[int, F.Column], df: DataFrame) -> DataFrame:
    """(c, v): the values of numbered columns below each other, without nulls."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), v.alias("v"))
                                         for i, v in values.items()])).alias("s")) \
             .select("s.c", "s.v").where(F.col("v").isNotNull())


SKETCH_K = 4096            # rank error of a merged sketch is some 0.1 %


def median_sketches(df: DataFrame, cols: list[str], period: F.Column, k: int = SKETCH_K) -> DataFrame:
    """(period, column, sketch): mergeable quantile sketches per period and
    column, a bounded number of bytes each; store them and add new periods.
    Nulls and NaN are left out."""
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    stacked = df.select(period.alias("period"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), value(c).alias("v")) for c in cols])).alias("s"))
    return (stacked.where(F.col("s.v").isNotNull()).groupBy("period", F.col("s.column").alias("column"))
                   .agg(F.kll_sketch_agg_double("s.v", k).alias("sketch")))


def sketch_medians(sketches: DataFrame, k: int = SKETCH_K) -> dict:
    """M02 as an explicit choice for wide or growing data: medians of a training
    window from the stored sketches of its periods, without its rows. They are
    values of the data of nearly the middle rank; ``fit_medians`` is exact and
    the default."""
    merged = sketches.groupBy("column").agg(F.kll_merge_agg_double("sketch", k).alias("s"))
    rows = merged.select("column", F.kll_sketch_get_quantile_double("s", F.lit(0.5)).alias("m"))
    return {r["column"]: r["m"] for r in rows.collect()}            # one row per column


def fill_medians(df: DataFrame, medians: dict) -> DataFrame:
    vals = {c: v for c, v in medians.items() if c in df.columns}
    cols = {c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in vals.items()}
    return df.withColumns(cols) if cols else df


# V05 ------------------------------------------------------------------------
def select_features(df: DataFrame, feature_cols: list[str] | None = None) -> list[str]:
    if feature_cols is not None:
        return [c for c in feature_cols if c in df.columns]
    return [f.name for f in df.schema.fields
            if f.name not in EXCLUDED_FEATURES and isinstance(f.dataType, _NUMERIC)]


# V04 ------------------------------------------------------------------------
def align_features(df: DataFrame, feature_cols: list[str], keep: tuple[str, ...] = ()
                   ) -> DataFrame:
    present = set(df.columns)
    return df.select(*[F.col(k) for k in keep],
                     *[(F.col(c).cast("double") if c in present else F.lit(0.0)).alias(c)
                       for c in feature_cols])


# V06 ------------------------------------------------------------------------
_INT_RANGES = [("tinyint", -(2 ** 7), 2 ** 7 - 1), ("smallint", -(2 ** 15), 2 ** 15 - 1),
               ("int", -(2 ** 31), 2 ** 31 - 1), ("bigint", -(2 ** 63), 2 ** 63 - 1)]
_FLOAT32_MAX = 3.4028234663852886e38


def narrowed_types(df: DataFrame) -> DataFrame:
    """Per numeric column the narrowest type holding its min..max (one agg)."""
    ints = [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))]
    dbls = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    cols = ints + dbls
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, chosen_type string")
    aggs = []
    for c in cols:
        aggs += [F.min(c).cast("double").alias(f"{c}__mn"), F.max(c).cast("double").alias(f"{c}__mx")]
    wide = df.agg(*aggs)
    structs = []
    for c in cols:
        mn, mx = F.col(f"{c}__mn"), F.col(f"{c}__mx")
        if c in ints:
            t = F.lit("bigint")
            for name, lo, hi in reversed(_INT_RANGES):
                t = F.when((mn >= lo) & (mx <= hi), F.lit(name)).otherwise(t)
            t = F.when(mn.isNull(), F.lit("tinyint")).otherwise(t)
        else:
            t = F.when(mn.isNull() | ((mn >= -_FLOAT32_MAX) & (mx <= _FLOAT32_MAX)),
                       F.lit("float")).otherwise(F.lit("double"))
        structs.append(F.struct(F.lit(c).alias("column_name"), t.alias("chosen_type")))
    return wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def narrow(df: DataFrame) -> DataFrame:
    """V06 applied: every numeric column cast to its narrowest type; all other
    columns stay. Doubles that become floats keep 24 bits; computing stays in
    double before this step (DV1)."""
    chosen = {r["column_name"]: r["chosen_type"] for r in narrowed_types(df).collect()}   # per column
    return df.withColumns({c: F.col(c).cast(t) for c, t in chosen.items()}) if chosen else df


def with_history(txn: DataFrame, strategy: str = "bucketed") -> DataFrame:
    """Row-history features over a whole table, to be taken before it is split
    in time: a later row's first event is its card's first event of all."""
    return W.sequence_features(txn, strategy=strategy) if "card1" in txn.columns else txn


# M03 ------------------------------------------------------------------------
@dataclass
class FeatureStats:
    card_stats: DataFrame
    product_stats: DataFrame
    codes: DataFrame
    medians: dict
    feature_cols: list[str]

    @classmethod
    def fit(cls, train: DataFrame, strategy: str = "bucketed") -> "FeatureStats":
        rf = row_features(train)
        # fitted once, read by every transform
        cs = materialize(A.card_stats(rf), "table") if "card1" in rf.columns else None
        ps = materialize(A.product_stats(rf), "table") if "ProductCD" in rf.columns else None
        codes = materialize(fit_category_codes(rf), "table")
        stats = cls(cs, ps, codes, {}, [])
        full = stats._engineer(train, strategy)
        stats.medians = fit_medians(full)
        stats.feature_cols = select_features(full)
        return stats

    def _engineer(self, df: DataFrame, strategy: str) -> DataFrame:
        out = row_features(df)
        if self.card_stats is not None:
            out = A.with_card_aggregations(out, stats=self.card_stats)
        if self.product_stats is not None:
            out = A.with_product_aggregations(out, stats=self.product_stats)
        if "card_txn_rank" not in out.columns:
            out = with_history(out, strategy)
        return apply_category_codes(out, self.codes)

    def save(self, path: str) -> None:
        """Every fitted table and value, for scoring in another session."""
        for name in ("card_stats", "product_stats", "codes"):
            if getattr(self, name) is not None:
                getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        values = json.dumps({"medians": self.medians, "feature_cols": self.feature_cols,
                             "tables": [n for n in ("card_stats", "product_stats", "codes")
                                        if getattr(self, n) is not None]})
        spark = self.codes.sparkSession
        spark.createDataFrame([(values,)], "v string").coalesce(1) \
             .write.mode("overwrite").text(f"{path}/values")

    @classmethod
    def load(cls, spark, path: str) -> "FeatureStats":
        v = json.loads(spark.read.text(f"{path}/values").first()[0])
        tables = {n: spark.read.parquet(f"{path}/{n}") for n in v["tables"]}
        return cls(tables.get("card_stats"), tables.get("product_stats"), tables["codes"],
                   v["medians"], v["feature_cols"])

    def transform(self, df: DataFrame, strategy: str = "bucketed",
                  keep: tuple[str, ...] = ("TransactionID", "isFraud")) -> DataFrame:
        out = fill_medians(self._engineer(df, strategy), self.medians)
        keep = tuple(k for k in keep if k in out.columns)
        return out.select(*keep, *[c for c in self.feature_cols if c not in keep])


def build_feature_matrix(df: DataFrame, strategy: str = "bucketed") -> tuple[DataFrame, list[str]]:
    """Fit on ``df`` and transform it (training mode)."""
    st = FeatureStats.fit(df, strategy)
    return st.transform(df, strategy), st.feature_cols
