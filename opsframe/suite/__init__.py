"""One registered query per operator, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opsframe.fixtures import Fixtures, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``fn(fixtures)`` under ``name`` with its oracle SQL."""
    def register(fn: Callable[[Fixtures], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Fixtures(spark, folder))
        if sql is not None:
            ORACLE[name] = oracle(sql)
        return fn
    return register


def load() -> None:
    """Imports the modules that register queries."""
    from opsframe.suite import (  # noqa: F401
        aggregates, calendar, expressions, feeds, filters, graph, joins, series, sources,
    )
