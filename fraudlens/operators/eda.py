"""Exploratory report sink (S13 with V07, A04-A06, A09): each table is a
distributed aggregate written as JSON lines next to the others."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudlens.operators import aggregations as A
from fraudlens.operators import validation as VAL


def report_tables(df: DataFrame, label: str = "isFraud", amount: str = "TransactionAmt"
                  ) -> dict[str, DataFrame]:
    out = {"summary": VAL.summary(df), "missing_top20": A.missing_fraction(df, 20),
           "missing_top30": A.missing_fraction(df, 30)}
    if label in df.columns:
        out["fraud_rate"] = A.fraud_rate(df, label)
        out["class_counts"] = A.class_counts(df, label)
    if amount in df.columns:
        out["amount_hist_100"] = A.equal_width_histogram(df, amount, 100)
        out["log_amount_hist_80"] = A.equal_width_histogram(df, F.log1p(amount), 80)
        if label in df.columns:
            out["amount_hist_by_class_50"] = A.equal_width_histogram(df, amount, 50, by=label)
    return out


def write_reports(df: DataFrame, out_dir: str, label: str = "isFraud") -> dict[str, str]:
    paths = {}
    for name, t in report_tables(df, label).items():
        p = f"{out_dir.rstrip('/')}/{name}"
        t.write.mode("overwrite").json(p)
        paths[name] = p
    return paths
