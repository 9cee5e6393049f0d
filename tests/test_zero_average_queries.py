"""Queries over decided events where cards have an average of 0 so far: the
rows of the SQL, and no division error."""
import datetime
import os

import duckdb
import pytest

from conftest import ROOT  # noqa: F401  (puts the repository on the path)
import __spark_entry__ as E
from tools.oracle_check import compare

NAMES = ["a15_rule_hits", "j06_prediction_transaction_join", "j07_alert_transaction_join",
         "k02_recent_by_decision", "k03_undelivered_alerts", "k05_enabled_rules",
         "k07_point_lookup"]


@pytest.fixture(scope="module")
def zero_tables(spark, tmp_path_factory):
    """12 cards of 8 events, half of them seconds apart: every third card begins
    with an amount of 0, every fourth has no other amount."""
    start, rows = datetime.datetime(2024, 1, 1), []
    for card in range(12):
        for k in range(8):
            amount = 0.0 if card % 4 == 0 or (card % 3 == 0 and k == 0) else 5.0 + 3 * card + 90 * (k == 5)
            at = start + datetime.timedelta(hours=card, seconds=20 * k if k < 4 else 86400 * k)
            rows.append((card * 8 + k, at, card, "error" if k == 2 else "view", amount, '{"k": %d}' % (7 * k)))
    path = str(tmp_path_factory.mktemp("zero_average"))
    tables = {"events": spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, "
                                                    "event_type string, value double, props string"),
              "labels": spark.createDataFrame([(i, 1, i % 2) for i in range(0, 96, 5)],
                                              "doc_id long, quality int, toxic int")}
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name, df in tables.items():
        df.coalesce(1).write.parquet(os.path.join(path, f"{name}.parquet"))
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/{name}.parquet/*.parquet')")
    return path, con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_the_sql(spark, zero_tables, name):
    path, con = zero_tables
    assert compare(E.queries()[name](spark, path), con, E.oracle_sql()[name]) == []
