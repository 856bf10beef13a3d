"""Registered queries and the SQL beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from indoorspark.fixtures import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    """Register a function of (spark, sf_dir); sql is checked over the named fixture views."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = oracle(sql, *views)
        return f

    return add
