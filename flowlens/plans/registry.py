"""All queries of the library with their DuckDB text, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import Tables, with_views

MODULES = ("log_queries", "chain_queries", "ledger_queries", "conformance_queries", "feature_queries", "analysis_queries", "document_queries", "source_queries", "detail_queries", "planted_queries")


def _all() -> tuple[dict, dict]:
    found, views = {}, {}
    for name in MODULES:
        module = import_module(f"{__package__}.{name}")
        found |= module.QUERIES
        views |= getattr(module, "VIEWS", {})
    return found, views


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, folder, f=f: f(Tables(spark, folder))) for name, (f, _) in _all()[0].items()}


def oracle_sql() -> dict[str, str]:
    found, views = _all()
    return {name: with_views(sql, views) for name, (_, sql) in found.items() if sql}
