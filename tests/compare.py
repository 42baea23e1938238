"""Run a query and its SQL and compare row counts, columns and values."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Seconds of the last comparison, by side.
TIMES: dict[str, float] = {}

KINDS = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "VARCHAR": "string",
    "DOUBLE": "double",
    "BOOLEAN": "boolean",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def _rows(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str) -> str | None:
    """None when equal, else a short account of what differs."""
    began = time.time()
    got = [tuple(r) for r in df.collect()]
    TIMES["spark"], began = time.time() - began, time.time()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    TIMES["sql"] = time.time() - began
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    kinds = {r[0]: KINDS.get(r[1], r[1]) for r in con.execute(f"describe {sql}").fetchall()}
    if kinds != dict(df.dtypes):
        return f"types {sorted(df.dtypes)} != {sorted(kinds.items())}"
    a, b = _rows(df.columns, got), _rows(names, want)
    if a == b:
        return None if a else "no rows"
    only_a = sorted(set(a) - set(b))[:3]
    only_b = sorted(set(b) - set(a))[:3]
    return f"rows {len(a)} / {len(b)}; {sorted(names)}; only here {only_a}; only there {only_b}"
