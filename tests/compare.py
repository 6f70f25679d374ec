"""Compare a query with its DuckDB oracle: columns, kinds of types, and rows in any order."""

from __future__ import annotations

import os

import duckdb

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def difference(df, sql: str, con) -> str:
    """What differs, or nothing."""
    want = con.sql(sql)
    names = sorted(want.columns)
    if sorted(df.columns) != names:
        return f"columns {sorted(df.columns)} and {names}"
    types = dict(zip(want.columns, map(str, want.types), strict=True))
    odd = {c: (k, types[c]) for c, k in df.dtypes if KINDS.get(k, k) != types[c]}
    if odd:
        return f"types {odd}"
    rows = lambda got: sorted(map(repr, got))
    a = rows(tuple(r[c] for c in names) for r in df.collect())
    b = rows(want.select(*[duckdb.ColumnExpression(c) for c in names]).fetchall())
    if a != b:
        off = [(x, y) for x, y in zip(a, b, strict=False) if x != y][:2]
        return f"{len(a)} and {len(b)} rows; {off}"
    return ""
