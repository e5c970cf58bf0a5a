"""All named queries of the engine with their SQL counterparts.

A query is a function of (spark, sf_dir); ``sql`` is what DuckDB runs on the same tables, absent where SQL cannot say it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Run] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Run], Run]:
    """Register a function under its own name."""

    def add(run: Run) -> Run:
        if run.__name__ in _QUERIES:
            raise ValueError(f"{run.__name__} is registered already")
        _QUERIES[run.__name__] = run
        if sql:
            _SQL[run.__name__] = sql
        return run

    return add


def _load() -> None:
    from . import canned, documents, filters, finance, ingest, search, writes  # noqa: F401


def queries() -> dict[str, Run]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
