"""Compare registered queries with their DuckDB forms, row by row."""

from __future__ import annotations

import glob
import math
import os
from decimal import Decimal

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, (int, Decimal)):
        return ("n", float(value))
    if isinstance(value, float):
        return ("n", None if math.isnan(value) else value)
    if isinstance(value, (list, tuple)):
        return ("l", tuple(_plain(v) for v in value))
    return ("s", None if value is None else str(value))


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted([tuple(_plain(r[i]) for i in order) for r in data], key=repr)


_KIND = {
    "bigint": "int64", "int": "int32", "double": "double", "float": "float", "string": "varchar", "boolean": "boolean",
    "date": "date", "timestamp": "timestamp", "tinyint": "int8", "timestamp_ntz": "timestamp",
}
_DUCK = {"bigint": "int64", "integer": "int32", "tinyint": "int8"}


def difference(df, con, sql) -> str | None:
    """None when equal, else what differs first."""
    data = df.collect()
    result = con.execute(sql)
    duck_types = {d[0]: str(d[1]).lower() for d in result.description}
    expected = result.fetchall()
    names, got = rows(df.columns, data)
    duck_names, want = rows([d[0] for d in result.description], expected)
    if names != duck_names:
        return f"columns {names} != {duck_names}"
    for field in df.schema.fields:
        mine = _KIND.get(field.dataType.simpleString(), field.dataType.simpleString())
        theirs = _DUCK.get(duck_types[field.name], duck_types[field.name])
        if mine != theirs:
            return f"type of {field.name}: {mine} != {theirs}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{dict(zip(names, a))} != {dict(zip(names, b))}"
    return None if got else "no rows"
