"""Queries and their oracles, registered side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.views import PRELUDE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Rows of the operator inventory that a query covers.
ROWS: dict[str, tuple[int, ...]] = {}


def query(name: str, *rows: int, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Register a query; views names the adapter views that its SQL starts from."""

    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name], ROWS[name] = run, rows
        if sql is not None:
            body = sql.strip()
            parts = [f"{v} AS ({PRELUDE[v]})" for v in views.split()]
            if parts:
                recursive = body.upper().startswith("WITH RECURSIVE ")
                rest = body[15 if recursive else 5 :].lstrip() if body[:5].upper() == "WITH " else None
                body = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + (f",\n{rest}" if rest else f"\n{body}")
            ORACLES[name] = body
        return run

    return register
