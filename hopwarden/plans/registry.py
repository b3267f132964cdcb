"""Queries by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        """Register a function under its own name; `sql` is left out where SQL cannot express the operator."""

        def add(f: Query) -> Query:
            key = name or f.__name__
            if key in self.queries:
                raise ValueError(f"query {key} is registered twice")
            self.queries[key] = f
            if sql is not None:
                self.sql[key] = sql
            return f

        return add

    def include(self, other: Registry) -> None:
        for key, f in other.queries.items():
            self.query(other.sql.get(key), key)(f)
