"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def family() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str], Callable]:
    """(queries, oracles, decorator): the decorator files a function under its name, with its SQL if there is one."""
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None):
        def file(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return file

    return queries, oracles, query
