"""Values relative to a group."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def pool_rank(x: str, group: list[str]) -> Column:
    """percent_rank with null members in the pool at rank 0."""
    return F.percent_rank().over(Window.partitionBy(*group).orderBy(F.col(x).asc_nulls_first()))


def member_rank(x: str, group: list[str]) -> Column:
    """percent_rank among the members that have a value; null for the others."""
    w = Window.partitionBy(*group, F.col(x).isNull()).orderBy(x)
    return F.when(F.col(x).isNotNull(), F.percent_rank().over(w))


def zscore(x: str, group: list[str]) -> Column:
    """Population z-score; null where the group has no spread."""
    w = Window.partitionBy(*group)
    return (F.col(x) - F.avg(x).over(w)) / F.nullif(F.stddev_pop(x).over(w), F.lit(0.0))


def softmax(score: Column, group: list[str]) -> Column:
    """exp(score) over its group's sum, after taking the group's maximum away."""
    w = Window.partitionBy(*group)
    e = F.exp(score - F.max(score).over(w))
    return e / F.sum(e).over(w)
