"""Run a registered query and its SQL counterpart, and compare columns, kinds and all values."""

from __future__ import annotations

import math

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _kind(type_name: str) -> str:
    name = type_name.lower()
    if name.startswith(("string", "varchar")):
        return "text"
    if name.startswith("timestamp"):
        return "timestamp"
    return {"integer": "int", "bigint": "bigint", "double": "double", "boolean": "boolean"}.get(name, name)


def _cell(value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, float):
        return repr(value + 0.0 if value else 0.0)
    return str(value)


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between the two results; empty if nothing does."""
    columns = sorted(df.columns)
    cursor = con.execute(sql)
    described = {d[0]: str(d[1]) for d in cursor.description}
    if sorted(described) != columns:
        return [f"columns: {columns} against {sorted(described)}"]
    names = [d[0] for d in cursor.description]
    theirs = sorted(tuple(_cell(dict(zip(names, r))[c]) for c in columns) for r in cursor.fetchall())
    ours = sorted(tuple(_cell(r[c]) for c in columns) for r in df.collect())
    found = []
    kinds = {c: (_kind(t), _kind(described[c])) for c, t in df.dtypes}
    found += [f"type of {c}: {a} against {b}" for c, (a, b) in kinds.items() if a != b]
    if len(ours) != len(theirs):
        found.append(f"rows: {len(ours)} against {len(theirs)}")
    only_ours, only_theirs = sorted(set(ours) - set(theirs)), sorted(set(theirs) - set(ours))
    if ours != theirs:
        found.append(f"values ({columns}): {len(only_ours)} only here, e.g. {only_ours[:2]}; {only_theirs[:2]}")
    return found
