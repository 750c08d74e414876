"""The catalogue: a query's name, its DataFrame form and, where SQL can say it, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its own name, with the SQL that has to agree with it."""

    def add(function: Query) -> Query:
        name = function.__name__
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """Imports all sets of queries."""
    from siltstone.plans.sets import (  # noqa: F401
        checks,
        devices,
        history,
        index,
        layout,
        logs,
        passes,
        recovery,
        rules,
        shapes,
        storage,
    )

    return QUERIES, ORACLE_SQL
