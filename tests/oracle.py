"""Compare Spark results with their SQL twins, column by column and row by row."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def differences(df, con, sql: str) -> list[str]:
    """What differs between a DataFrame and a SQL result; empty when nothing does."""
    problems = []
    cur = con.execute(sql)
    sql_types = {d[0]: str(d[1]) for d in cur.description}
    names = sorted(df.columns)
    if names != sorted(sql_types):
        return [f"columns {names} against {sorted(sql_types)}"]
    for name, kind in df.dtypes:
        if KINDS.get(kind, kind) != sql_types[name]:
            problems.append(f"type of {name}: {kind} against {sql_types[name]}")
    order = list(sql_types)
    expected = _sorted([tuple(_cell(r[order.index(n)]) for n in names) for r in cur.fetchall()])
    found = _sorted([tuple(_cell(r[n]) for n in names) for r in df.collect()])
    if len(expected) != len(found):
        problems.append(f"{len(found)} rows against {len(expected)}")
    if found != expected:
        here, there = set(found), set(expected)
        missing, extra = sorted(there - here, key=str)[:3], sorted(here - there, key=str)[:3]
        problems.append(f"values differ: only here {str(extra)[:600]}, only there {str(missing)[:600]}")
    return problems
