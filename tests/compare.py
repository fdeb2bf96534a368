"""Rows of a Spark query against rows of its SQL in DuckDB."""

import math
from collections import Counter
from pathlib import Path

import duckdb

from snapstride.session import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        if path.exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return round(float(value), 6) + 0.0
    return str(value)


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def assert_same(spark, query, sql: str, sf_dir: str) -> None:
    df = query(spark, sf_dir)
    found = bag(df.columns, df.collect())
    con = connect(sf_dir)
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    wanted = bag(columns, result.fetchall())
    assert found == wanted, (list((found - wanted).items())[:3], list((wanted - found).items())[:3])
