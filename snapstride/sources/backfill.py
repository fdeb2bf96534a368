"""Backfills over seasons that are resumed and repaired."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def two_passes(rows: DataFrame, season: str, good: Column, again: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """season, rows, failed, residual, complete.

    The first pass builds every row and counts those that fail. Only seasons with failures are
    read again from the cached rows, built by ``again``; what still fails is the residual, and
    a season without one is complete.
    """
    first = rows.groupBy(season).agg(F.count(F.lit(1)).alias("rows"), F.count_if(~good).alias("failed"))
    broken = first.filter("failed > 0").select(season)
    second = again(rows.join(F.broadcast(broken), season, "left_semi")).groupBy(season).agg(F.count_if(~good).alias("residual"))
    found = first.join(second, season, "left").withColumn("residual", F.coalesce("residual", F.lit(0)))
    return found.withColumn("complete", F.col("residual") == 0)
