"""All registered queries of the corpus operators, with their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with the DuckDB SQL that gives the same rows."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def oracle_of(name: str) -> str:
    """The SQL of a query registered before, to build on."""
    return _SQL[name]


def _load() -> None:
    for name in ("corpus_queries", "fitness_queries", "structure_queries", "monitor_queries", "audit_queries", "chain_queries", "summary_queries", "model_queries", "board_queries"):
        importlib.import_module(f"strandline.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
