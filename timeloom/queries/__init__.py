"""Registered queries of the library's own operators on the given tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERIES and SQL.
MODULES = ("segments", "sequences", "joining", "measuring", "scalar", "quality", "models", "streams", "files")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in import_module(f"timeloom.queries.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in import_module(f"timeloom.queries.{m}").SQL.items()}
