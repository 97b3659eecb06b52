"""Registry of named queries and the ANSI text each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auditlake.sources.views import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn):
        QUERIES[name] = lambda spark, path: fn(Tables(spark, path))
        if oracle is not None:
            ORACLE[name] = with_views(oracle)
        return fn

    return register


def sql_list(values) -> str:
    """A parameter list as SQL literals, for check texts."""
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)
