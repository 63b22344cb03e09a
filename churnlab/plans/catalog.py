"""Registry of the named queries run by the driver contract and the benchmark.

Each query is a function ``(spark, sf_dir) -> DataFrame`` over the test
tables (through the stand-ins in ``churnlab.sources.fixtures``).  Queries
whose result can be stated in SQL also register DuckDB SQL for the oracle
check; the stand-in CTEs they need are prepended automatically.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from churnlab.sources.fixtures import with_ctes

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_MODULES = [
    "churnlab.plans.q_profile",
    "churnlab.plans.q_rates",
    "churnlab.plans.q_scalar",
    "churnlab.plans.q_clean",
    "churnlab.plans.q_features",
    "churnlab.plans.q_charts",
    "churnlab.plans.q_metrics",
    "churnlab.plans.q_boost",
    "churnlab.plans.q_model",
    "churnlab.plans.q_flows",
]


def register(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Decorator: register a query and (optionally) its oracle SQL."""
    def deco(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_ctes(sql.strip(), *ctes)
        return fn
    return deco


def load_all() -> None:
    for m in _MODULES:
        importlib.import_module(m)


def all_queries() -> dict[str, Query]:
    load_all()
    return dict(QUERIES)


def all_oracle_sql() -> dict[str, str]:
    load_all()
    return dict(ORACLE)
