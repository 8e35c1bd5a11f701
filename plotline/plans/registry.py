"""Registered queries: a Spark callable and, where SQL can say the same, its oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plotline.plans.fixture import EVERYWHERE, prefix

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
CTES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``(spark, sf_dir) -> DataFrame`` under ``name``."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return add


def variants(template: str, sql: Callable[[str], str], names: list[str]) -> Callable:
    """Register one query per name; the callable takes the name as third argument."""

    def add(fn: Callable[[SparkSession, str, str], DataFrame]) -> Callable:
        for n in names:
            query(template.format(n), sql(n))(lambda spark, d, n=n: fn(spark, d, n))
        return fn

    return add


def oracles() -> dict[str, str]:
    """Complete oracle statements, each with the views it needs."""
    return {n: prefix(sql, CTES).replace(EVERYWHERE, ", 'g'") for n, sql in _SQL.items()}
