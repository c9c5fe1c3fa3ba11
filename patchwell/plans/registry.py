"""Collects the queries of the plan modules; each module fills its own ``Book``."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ("labels", "names", "support", "components", "splits", "intervals", "metrics",
           "calibration", "shift", "geometry", "models", "fits", "robustness", "audits", "storage")


class Book:
    """Queries of one family with their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(fn: Query) -> Query:
            if name in self.queries:
                raise KeyError(name)
            self.queries[name] = fn
            if sql:
                self.sql[name] = sql
            return fn
        return keep


def _books() -> list[Book]:
    return [import_module(f"{__package__}.{m}").BOOK for m in MODULES]


def all_queries() -> dict[str, Query]:
    return {k: q for book in _books() for k, q in book.queries.items()}


def all_sql() -> dict[str, str]:
    return {k: s for book in _books() for k, s in book.sql.items()}
