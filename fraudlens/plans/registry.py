"""Registry of named queries: each entry is a Spark builder ``(spark, sf_dir)
-> DataFrame`` and, when the operator is SQL-expressible, the DuckDB oracle
text that must return the same rows over the raw driver tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn
    return deco


def load_all() -> None:
    # import for the registration side effect
    from fraudlens.plans import (q_features, q_aggregates, q_windows,  # noqa: F401
                                 q_rules, q_store, q_metrics, q_monitoring, q_sources, q_ml,
                                 q_streams)
