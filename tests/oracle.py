"""Holds a query against its SQL in DuckDB on the same tables."""

import glob
import os
from collections import Counter

import duckdb


def connect(data: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(df) -> tuple[list[str], Counter]:
    cols = sorted(df.columns)
    return cols, Counter(tuple(str(x) if hasattr(x, "year") else x for x in r) for r in df.select(*cols).collect())


def sql_rows(c, sql: str) -> tuple[list[str], Counter]:
    r = c.execute(sql)
    names = [x[0] for x in r.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], Counter(tuple(str(x[i]) if hasattr(x[i], "year") else x[i] for i in order) for x in r.fetchall())
