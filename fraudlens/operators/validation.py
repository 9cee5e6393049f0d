"""Row validation and batch bounds (V01-V03, V07, D07 fallback, S09 routing).

Validation is an array of violated field names per row, built with ``when``
expressions; valid and invalid rows are two filters of the same projection.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed request limits.
MAX_AMOUNT = 1_000_000
MAX_CARD1 = 65535
MAX_LENGTHS = {
    "ProductCD": 8,
    "card4": 32,
    "card6": 32,
    "P_emaildomain": 128,
    "R_emaildomain": 128,
    "DeviceType": 32,
    "DeviceInfo": 256,
}
MIN_BATCH, MAX_BATCH = 1, 1000
DEFAULT_BATCH_ROWS = 500


def violations(df: DataFrame) -> F.Column:
    cols = set(df.columns)
    checks = []
    dt = F.col("TransactionDT") if "TransactionDT" in cols else F.lit(None)
    checks.append(F.when(dt.isNull() | (dt < 0), F.lit("TransactionDT")))
    amt = F.col("TransactionAmt") if "TransactionAmt" in cols else F.lit(None)
    checks.append(F.when(amt.isNull() | (amt <= 0) | (amt > MAX_AMOUNT) | F.isnan(amt),
                         F.lit("TransactionAmt")))
    if "card1" in cols:
        c = F.col("card1")
        checks.append(F.when((c < 0) | (c > MAX_CARD1), F.lit("card1")))
    for name, n in MAX_LENGTHS.items():
        if name in cols:
            checks.append(F.when(F.length(F.col(name)) > n, F.lit(name)))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def validate(df: DataFrame) -> DataFrame:
    out = df.withColumn("violations", violations(df))
    return out.withColumn("is_valid", F.size("violations") == 0)


def batch_bounds(df: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    return (df.groupBy(batch_col).agg(F.count(F.lit(1)).alias("n"))
              .withColumn("within_bounds", F.col("n").between(MIN_BATCH, MAX_BATCH)))


def summary(df: DataFrame) -> DataFrame:
    dtypes = ",".join(f"{n}:{t}" for n, t in df.dtypes)
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(dtypes).alias("dtypes"))
