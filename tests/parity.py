"""Compare a query with its SQL on DuckDB: names, row count and values in any order."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "to_pydatetime"):
        value = value.to_pydatetime()
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return bool(value)
    if isinstance(value, float):
        return round(value, 6)
    return value.item() if hasattr(value, "item") else value


def rows_of(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr(tuple(_plain(r[i]) for i in order)) for r in rows)


def kinds(con, sql: str) -> dict[str, str]:
    return {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}


def difference(df, con, sql: str) -> str | None:
    got_rows = df.collect()
    cursor = con.execute(sql)
    want_columns = [c[0] for c in cursor.description]
    if sorted(df.columns) != sorted(want_columns):
        return f"columns {sorted(df.columns)} != {sorted(want_columns)}"
    got, want = rows_of(df.columns, got_rows), rows_of(want_columns, cursor.fetchall())
    if got == want:
        return None
    only_got, only_want = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
    return f"{len(got)} vs {len(want)} rows; only Spark {only_got}; only SQL {only_want}"
