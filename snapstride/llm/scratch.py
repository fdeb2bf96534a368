"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``, so a lost executor costs a
re-read, never a recomputation of earlier stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir

__all__ = ["free_name", "row_keys", "shared_dir", "staged"]


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: computed once, whatever reads it later."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_keys(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """``docs`` and the name of a column that tells all its rows apart: ``id_col`` if it does.

    Where ids are null or repeat, the rows are written with a number of their own.
    """
    ids = docs.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    if ids.filter("id is null or n > 1").isEmpty():
        return docs, id_col
    key = free_name(docs, "row_key")
    return staged(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key
