"""Helpers shared by the training-data operators."""
from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fraudlens.session import scratch_path

LEAST_ID = -(2 ** 63)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The white space of the contracts: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame written once as Parquet in the shared folder and reread:
    later jobs read the table instead of recomputing it, also after an
    executor is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def words(c: Column) -> Column:
    """Words of a text in order; a null or blank text has none."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), SPACE_CLASS + "+", -1), "")


def identity(id_col: str, text_col: str) -> list[Column]:
    """A document's order ``d`` (a null id comes first) and, to tell repeated
    ids with other texts, the hash ``th`` of its text."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_ID)).alias("d"),
            F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th")]


def lines(text: Column) -> Column:
    """Lines split at line feeds; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body
    (also inside its own lambdas) refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def gapless_rank(df: DataFrame, group: list[str], order: list[str], rank: str) -> DataFrame:
    """Adds a rank that counts 0, 1, 2, ... inside each group, in order.

    No window holds a whole group: rows are range-partitioned by group and
    order and written, each row's place in its partition is its rank but for
    an offset, and the offsets come from one count per (partition, group).
    As partitions are sorted ranges, that table has at most
    (partitions + groups) rows, which bounds what is broadcast. Null groups
    and order values sort first; equal rows get consecutive ranks."""
    ranged = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    placed = written(ranged.withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33).alias("__part")
    keys = [F.coalesce(F.col(g).cast("string"), F.lit("\0")).alias(f"__g{i}")
            for i, g in enumerate(group)]
    names = [f"__g{i}" for i in range(len(group))] + ["__part"]
    counts = placed.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("__n"),
                                             F.min("__at").alias("__first"))
    before = W.partitionBy(*names[:-1]).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("__shift", F.coalesce(F.sum("__n").over(before), F.lit(0))
                                - F.col("__first")).drop("__n", "__first")
    return (placed.select("*", *keys, part)
            .join(F.broadcast(offsets), names)
            .withColumn(rank, F.col("__at") + F.col("__shift"))
            .drop("__at", "__shift", *names))


def ship(module: str) -> None:
    """Task functions of the module travel to executors by value, so the
    package need not be installed there."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
