"""Every registered query with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the DuckDB statement of the same result."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in _QUERIES:
            raise ValueError(f"query {key} is registered twice")
        _QUERIES[key] = f
        if sql is not None:
            _SQL[key] = sql
        return f

    return add


def _fill() -> None:
    from codeloam.plans import code, history, parsers, vectors  # noqa: F401


def queries() -> dict[str, Query]:
    _fill()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _fill()
    return dict(_SQL)
