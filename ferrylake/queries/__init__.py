"""Registered queries: one Spark DataFrame builder per operator, each with the
DuckDB SQL that must give the same rows (the oracle), where SQL can say it.

Every query reads the driver's tables (or data Spark derives from them) in
whole; none caps, samples or filters rows to stay cheap.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def cores(spark: SparkSession) -> int:
    """The given tables are single files of one row group, so queries that spend
    their time on values say themselves over how many tasks to deal them."""
    return spark.sparkContext.defaultParallelism


def _load_all() -> None:
    # Import order = registration order.
    from ferrylake.queries import profile_q, resolve_q, scalar_q, objects_q, io_q  # noqa: F401,E501


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLE)
