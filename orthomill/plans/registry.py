"""Registry of runnable queries and, where SQL can say the same, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` together with its SQL twin."""
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def with_ctes(*ctes: str, select: str) -> str:
    """Compose ``WITH`` clauses and a final select."""
    recursive = "RECURSIVE " if any("/*recursive*/" in c for c in ctes) else ""
    return f"WITH {recursive}" + ",\n".join(c.strip() for c in ctes) + "\n" + select.strip()
