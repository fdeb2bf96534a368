"""Where queries and their SQL are entered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, dates: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Enters a query, and the DuckDB SQL that gives the same rows if there is one.

    ``dates`` leave both as ISO text, as the two engines' date columns differ in type.
    """

    def enter(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).withColumns({d: F.col(d).cast("string") for d in dates})

        QUERIES[name] = run if dates else f
        if sql is not None:
            iso = ", ".join(f"CAST({d} AS VARCHAR) AS {d}" for d in dates)
            SQL[name] = f"SELECT * REPLACE ({iso}) FROM ({sql})" if dates else sql
        return f

    return enter
