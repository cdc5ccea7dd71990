"""Registers of queries over the supplied tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def catalog() -> tuple[dict[str, Query], dict[str, str], Callable]:
    """An empty register of queries, one of their SQL, and the decorator that fills both."""
    queries: dict[str, Query] = {}
    oracle_sql: dict[str, str] = {}

    def query(sql: str | None = None):
        def register(f: Query) -> Query:
            queries[f.__name__] = f
            if sql is not None:
                oracle_sql[f.__name__] = sql
            return f

        return register

    return queries, oracle_sql, query
