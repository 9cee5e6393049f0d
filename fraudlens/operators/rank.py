"""Global order without a one-task window.

A window with no ``partitionBy`` moves every row into one task. Here rows are
range-partitioned on the order columns (bounds are sampled, in the columns'
own types, so outliers and large integers do not matter), written once, and
every partition's totals become offsets of the later ones:

* ``prefix_sums``: running totals over a sorted key;
* ``global_index``: the position of each row;
* ``kth_smallest`` and ``time_split``: exact selection from those;
* ``grouped_quantiles``: exact interpolated quantiles of every group.

The offset tables have at most (partitions + groups) rows, since sorted
ranges of one group are consecutive partitions.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fraudlens.session import materialize


def _ranged(df: DataFrame, *order: str | Column) -> DataFrame:
    """The rows in range partitions, with the partition's number ``_part``."""
    return materialize(df.repartitionByRange(*order)
                         .withColumn("_part", F.spark_partition_id()), "table")


def prefix_sums(df: DataFrame, key: str, cols: list[str], keys: tuple[str, ...] = (),
                descending: bool = False) -> DataFrame:
    """For every row: ``{c}_before`` = sum of ``c`` over rows with a strictly
    smaller key (strictly larger when descending) in the same ``keys`` group.
    Keys must be distinct within a group (group the data by key first)."""
    turn = F.desc(key) if descending else F.asc(key)
    placed = _ranged(df, *keys, turn)
    tot = placed.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    # without groups: one row per partition in this window, not the data
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part") \
                    .rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"),
                      *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}")
                        for c in cols])
    match = F.col("_part") == F.col("_p")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    w = Window.partitionBy(*keys, "_part").orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(offs, match).select(
        *df.columns,
        *[(F.coalesce(F.sum(c).over(w), F.lit(0)) + F.col(f"_o_{c}")).alias(f"{c}_before")
          for c in cols])


def global_index(df: DataFrame, order_col: str, tie_col: str, name: str = "_index") -> DataFrame:
    """0-based position of each row in (order_col, tie_col) order."""
    order = [order_col] if order_col == tie_col else [order_col, tie_col]
    placed = _ranged(df, *order)
    tot = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    w = Window.partitionBy("_part").orderBy(*order)
    return (placed.join(F.broadcast(offs), "_part")         # one row per partition
            .withColumn(name, F.row_number().over(w) - 1 + F.col("_off"))
            .drop("_part", "_off"))


def kth_smallest(df: DataFrame, key: str, k: int) -> tuple:
    """Value v of the k-th smallest ``key`` (1-based, nulls left out) and the
    number of rows with key < v, exact and in the column's own type."""
    counts = (df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k"))
                .agg(F.count(F.lit(1)).alias("_n")))
    hit = (prefix_sums(counts, "_k", ["_n"])
           .where((F.col("_n_before") < k) & (F.col("_n_before") + F.col("_n") >= k)).first())
    if hit is None:
        raise ValueError("k exceeds row count")
    return hit["_k"], hit["_n_before"]


def time_split(df: DataFrame, validation_fraction: float = 0.2, dt: str = "TransactionDT",
               id_col: str = "TransactionID") -> tuple[DataFrame, DataFrame]:
    """First int(n * (1 - f)) rows in time order train, the rest validate.
    Without a time column the order is the id order (positional split). Rows
    that are equal in time and id stay together, in the training part."""
    order = dt if dt in df.columns else id_col
    n = df.count()
    cut = int(n * (1 - validation_fraction))
    if cut <= 0:
        return df.limit(0), df
    if cut >= n:
        return df, df.limit(0)
    last = (global_index(df.select(F.col(order).alias("_o"), F.col(id_col).alias("_i")), "_o", "_i")
            .where(F.col("_index") == cut - 1).first())
    before = _up_to(F.col(order), last["_o"], strictly=order != id_col)
    if order != id_col:
        before = before | (F.col(order).eqNullSafe(F.lit(last["_o"]))
                           & _up_to(F.col(id_col), last["_i"], strictly=False))
    return df.where(before), df.where(~before)


def _up_to(c: Column, value, strictly: bool) -> Column:
    """c < value (or <=) in sort order, where a null comes first."""
    if value is None:
        return F.lit(False) if strictly else c.isNull()
    return c.isNull() | (c < F.lit(value)) if strictly else c.isNull() | (c <= F.lit(value))


def grouped_quantiles(df: DataFrame, keys: tuple[str, ...], value: str, probs: list[float]
                      ) -> DataFrame:
    """(keys, q0, q1, ...): exact quantiles of each group, interpolated as
    Spark's ``percentile`` does, without holding a group in one task.

    Counts per distinct (group, value) are reduced map-side, and running
    counts come from range partitions, so a group with a third of all rows is
    spread over many. Nulls are left out."""
    g = (df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v"))
           .agg(F.count(F.lit(1)).alias("_c")))
    ps = prefix_sums(g, "_v", ["_c"], keys=keys)
    tot = ps.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    if keys:
        tot = tot.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_n")
        match = F.lit(True)
        for k in keys:
            match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        j = ps.join(tot, match).drop(*[f"_k_{k}" for k in keys])
    else:
        j = ps.withColumn("_g", F.lit(0)).join(F.broadcast(tot.withColumn("_g", F.lit(0))), "_g")
    place, values, near = {}, [], F.lit(False)
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("_n") - 1)
        place[i] = at
        for side, k in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("_c_before") <= k) & (k < F.col("_c_before") + F.col("_c"))
            near = near | hit
            values.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{side}{i}"))
    picked = j.where(near).groupBy(*keys, "_n").agg(*values)
    out = []
    for i in range(len(probs)):
        lo, hi, at = F.col(f"_lo{i}"), F.col(f"_hi{i}"), place[i]
        out.append(F.when(F.floor(at) == F.ceil(at), lo).otherwise(
            (F.ceil(at) - at) * lo + (at - F.floor(at)) * hi).alias(f"q{i}"))
    return picked.select(*keys, *out)
