"""Registry of named queries, each with the SQL it must agree with."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    """A named query: ``run(spark, sf_dir)`` and, where SQL can express it, its DuckDB text."""

    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}

#: Modules that register queries when imported.
MODULES: list[str] = ["search_queries", "filter_queries", "text_queries", "geo_queries", "sql_queries", "engine_queries"]


def query(name: str, sql: str | None = None):
    """Register the decorated ``(spark, sf_dir) -> DataFrame`` under ``name``."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, fn, sql)
        return fn

    return register


def load_all() -> dict[str, Query]:
    """Import every query module and return the queries by name."""
    for module in MODULES:
        importlib.import_module(f"nearfield.plans.{module}")
    return QUERIES
