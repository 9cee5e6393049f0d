"""Registered queries against their DuckDB oracles (a fast sample by default;
FRAUDLENS_FULL_ORACLE=1 runs every SQL-checked query)."""
import os
import sys

import duckdb
import pytest

from conftest import ROOT, SF_SMALL

sys.path.insert(0, os.path.join(ROOT, "tools"))
import __spark_entry__ as E  # noqa: E402
from oracle_check import TABLES, compare  # noqa: E402

SAMPLE = ["f01_time_parts", "f09_email_tld", "v01_row_validation", "a01_card_stats",
          "a09_hist_by_class", "w01_w03_card_sequence", "w04_velocity_counts",
          "w06_amount_vs_30d_avg", "w07_w09_geography", "r02_r07_operator_semantics",
          "d01_d06_decisions_orders", "d08_scoring_record", "m08_roc_auc",
          "m10_f1_optimal_threshold", "k08_time_split", "t08_latency_quantiles",
          "u05_insert_unique", "s09_dead_letter", "m05_minority_knn"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF_SMALL, f"{t}.parquet")
        if os.path.exists(p):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def _names():
    orc = E.oracle_sql()
    if os.environ.get("FRAUDLENS_FULL_ORACLE"):
        return sorted(orc)
    return SAMPLE


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    assert compare(df, con, E.oracle_sql()[name]) == []


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "decision" in df.columns


def test_every_query_has_a_callable_and_sql_keys_exist():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100
