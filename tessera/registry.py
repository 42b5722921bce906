"""Operator id -> query and oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_PLANS = ("search", "graph", "state", "relational", "statistics", "packing", "code", "records", "streams", "extra")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under an operator's id, with the SQL that it must agree with."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    for p in _PLANS:
        importlib.import_module(f"tessera.plans.{p}")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _QUERIES["top_07_excerpts"](spark, sf_dir)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
