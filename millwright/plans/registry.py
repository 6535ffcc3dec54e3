"""All queries of the engine by name, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with the SQL that gives the same rows if SQL can."""

    def register(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return register


def oracle(name: str) -> str:
    """The SQL of a query that is registered already, for another way to the same rows."""
    return _SQL[name]


def _loaded() -> None:
    from millwright.plans import graph_queries, pattern_queries, record_queries, run_queries, store_queries, text_queries, triple_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _loaded()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _loaded()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["cq2_failure_shares"](spark, sf_dir)
