"""Run a registered query on Spark and its check statement on DuckDB, and compare."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb

_KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
    "DATE": "date", "BOOLEAN": "boolean", "VARCHAR[]": "array<string>", "HUGEINT": "hugeint",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(file)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{file}'")
    return con


def _norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.date().isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return repr(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short account of the first difference."""
    spark_types = dict(df.dtypes)
    cur = con.execute(sql)
    duck_cols = [d[0] for d in cur.description]
    duck_types = {d[0]: _KINDS.get(str(d[1]), str(d[1])) for d in cur.description}
    duck = cur.fetchall()
    if spark_types != duck_types:
        return f"types differ: spark {spark_types} duckdb {duck_types}"
    rows = [tuple(r) for r in df.collect()]
    if len(rows) != len(duck):
        return f"row counts differ: spark {len(rows)} duckdb {len(duck)}"
    a, b = _rows(df.columns, rows), _rows(duck_cols, duck)
    for x, y in zip(a, b):
        if x != y:
            return f"rows differ ({sorted(df.columns)}): spark {x} duckdb {y}"
    return None
