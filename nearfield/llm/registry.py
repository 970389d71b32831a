"""Names, functions and SQL of the queries over the corpus operators."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules of ``nearfield.llm.queries``, in the order of the operators.
MODULES = ["tokens", "selection", "quality", "near", "texts"]

Run = Callable[[SparkSession, str], DataFrame]


def _all() -> dict[str, tuple[Run, str | None]]:
    import corpus_pipeline

    found: dict[str, tuple[Run, str | None]] = {}
    for module in MODULES:
        found |= importlib.import_module(f"nearfield.llm.queries.{module}").QUERIES
    return found | {"pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)}


def queries() -> dict[str, Run]:
    return {name: run for name, (run, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
