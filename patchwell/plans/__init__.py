"""Registered queries and their reference SQL, one module per operator family."""

from __future__ import annotations

from .registry import all_queries, all_sql

__all__ = ["all_queries", "all_sql"]
