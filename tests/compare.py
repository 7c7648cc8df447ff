"""Side-by-side comparison of a Spark result and its reference SQL."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        if Path(f"{sf_dir}/{table}.parquet").exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else round(v, 9))
    if isinstance(v, list):
        return tuple(_value(x) for x in v)
    return v


def _rows(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Human-readable differences; empty when rows, columns and types agree."""
    result = con.execute(sql)
    theirs = [c[0] for c in result.description]
    kinds = {c[0]: str(c[1]) for c in result.description}
    out = []
    if sorted(theirs) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(theirs)}"]
    for name, kind in df.dtypes:
        if kind in KINDS and KINDS[kind] != kinds[name]:
            out.append(f"type of {name}: {kind} against {kinds[name]}")
    want = _rows(theirs, result.fetchall())
    have = _rows(df.columns, [tuple(r) for r in df.collect()])
    if want != have:
        out.append(f"rows {sum(have.values())} against {sum(want.values())}")
        out += [f"  only here: {r}" for r in list((have - want).elements())[:4]]
        out += [f"  only there: {r}" for r in list((want - have).elements())[:4]]
    if not sum(want.values()):
        out.append("both sides are empty")
    return out
