"""Runs a query in Spark and its SQL in DuckDB and compares schemas and rows, whatever their order."""

from __future__ import annotations

import math
import os

import duckdb

from quaystone.plans.catalog import TABLES

KINDS = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "int": "INTEGER", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return repr(v)


def compare(df, con, sql: str) -> list[str]:
    """What differs; empty if nothing does."""
    cols = sorted(df.columns)
    out = []
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return [f"columns {cols} and {sorted(rel.columns)}"]
    kinds = dict(df.dtypes)
    theirs = dict(zip(rel.columns, map(str, rel.types)))
    for c in cols:
        if KINDS.get(kinds[c], kinds[c]) != theirs[c]:
            out.append(f"type of {c}: {kinds[c]} and {theirs[c]}")
    a = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    quoted = ", ".join(f'"{c}"' for c in cols)
    b = sorted(tuple(norm(v) for v in r) for r in con.execute(f"SELECT {quoted} FROM ({sql}) q").fetchall())
    if a != b:
        out.append(f"{len(a)} and {len(b)} rows; only in Spark {[x for x in a if x not in set(b)][:2]}, only in SQL {[x for x in b if x not in set(a)][:2]}")
    if not a:
        out.append("no rows")
    return out
