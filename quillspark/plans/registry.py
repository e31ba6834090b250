"""A registry of named queries, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        """Registers a function of (spark, sf_dir)."""

        def wrap(f):
            assert name not in self.queries, name
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return wrap
