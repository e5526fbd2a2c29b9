"""The text queries by name and, where SQL can say it on whole tables, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

_MODULES = (
    "toxicity",
    "neighbours",
    "archives",
    "decontamination",
    "sharding",
    "simhash",
    "url_rules",
    "mixing",
    "licenses",
    "quality",
    "ngram_join",
    "resampling",
    "negatives",
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, optionally with its SQL."""

    def register(fn: Query) -> Query:
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return register


def load_all() -> tuple[dict[str, Query], dict[str, str]]:
    for name in _MODULES:
        import_module(f"tapeloom.llm.{name}")
    return dict(_QUERIES), dict(_SQL)
