"""The catalogue of registered queries: a function per query, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(literal(v) for v in value) + "]"
    return repr(value)


def values(rows: list[tuple], columns: str, name: str = "v") -> str:
    """A common table expression of literal rows."""
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(literal(x) for x in r) + ')' for r in rows)})"


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from larkspur.plans import engine_queries, retrieval_queries, surface_queries, text_queries  # noqa: F401

    return QUERIES, SQL
