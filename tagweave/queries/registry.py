"""Registered queries: name to Spark function and, where SQL can say it, the check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tagweave.queries.inputs import check_sql

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        REGISTRY[name] = (fn, sql)
        return fn
    return add


def queries() -> dict[str, Query]:
    return {name: fn for name, (fn, _sql) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: check_sql(sql) for name, (_fn, sql) in REGISTRY.items() if sql}
