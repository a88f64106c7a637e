"""Compare a registered query with its SQL, as sorted rows of normalised values."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if isinstance(v, int):
        return repr(float(v))
    return str(v).replace("+00:00", "")


def rows(columns: list[str], data: list) -> list:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def spark_rows(df) -> tuple[list[str], list]:
    return sorted(df.columns), rows(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql: str) -> tuple[list[str], list]:
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    return sorted(columns), rows(columns, found.fetchall())
