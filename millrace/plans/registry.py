"""Pairs a DataFrame plan over the domain tables with the same query in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.bridge import Domain, duckdb_views


class Plans:
    """Queries by name, and their SQL."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, views: str, sql: str | None = None):
        """Registers a function of the domain; ``views``: the domain tables that the SQL reads."""

        def register(plan: Callable[[Domain], DataFrame]):
            self.queries[name] = lambda spark, folder: plan(Domain(spark, folder))
            if sql:
                self.sql[name] = f"{duckdb_views(*views.split())}\n{sql}" if views else sql
            return plan

        return register


def joined(array: str, expression: str) -> str:
    """SQL for an array of structs as text, each by an expression over x."""
    return f"array_join(transform({array}, x -> {expression}), ';')"
