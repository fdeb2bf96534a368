"""As-of joins with an equality key, in both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(left: DataFrame, right: DataFrame, keys: list[str], at: str, when: str, order: list[str], values: list[str]) -> DataFrame:
    """Each left row with the ``values`` of the last right row with ``when`` <= ``at``.

    Ties on ``when`` go to the greatest ``order``. Both sides are stacked and sorted once by
    key and time, so cost is that of a sort whatever the number of matches; a range join
    would first make all pairs.
    """
    packed = F.struct(*[F.col(c) for c in values])
    a = left.select(*left.columns, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.struct(*[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in order]).alias("__o"), F.lit(None).cast(_struct(right, values)).alias("__v"))
    b = right.select(*[F.col(k) if k in keys else F.lit(None).cast(left.schema[k].dataType).alias(k) for k in left.columns], F.col(when).alias("__t"), F.lit(0).alias("__side"), F.struct(*[F.col(c) for c in order]).alias("__o"), packed.alias("__v"))
    run = Window.partitionBy(*keys).orderBy("__t", "__side", "__o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stacked = a.unionByName(b).withColumn("__v", F.last("__v", ignorenulls=True).over(run))
    return stacked.filter("__side = 1").select(*left.columns, *[F.col(f"__v.{c}").alias(c) for c in values])


def _struct(df: DataFrame, names: list[str]):
    from pyspark.sql import types as T

    return T.StructType([T.StructField(n, df.schema[n].dataType) for n in names])


def _nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, when: str, value: str, ahead: bool) -> DataFrame:
    """Left rows with ``__v``, the (when, value) of the nearest right row at ``at`` or after (before) it.

    Both sides are stacked and sorted once by key and time, so the cost is that of a sort
    whatever the number of right rows in reach.
    """
    near = F.struct(F.col(when).alias("when"), F.col(value).alias("value"))
    a = left.select(*left.columns, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.select(near.alias("v")).schema["v"].dataType).alias("__v"))
    others = [F.col(k) if k in keys else F.lit(None).cast(left.schema[k].dataType).alias(k) for k in left.columns]
    b = right.select(*others, F.col(when).alias("__t"), F.lit(0).alias("__side"), near.alias("__v"))
    # a right row at the same time comes first in both directions
    time = F.col("__t").desc() if ahead else F.col("__t").asc()
    ties = F.col("__v").desc() if ahead else F.col("__v").asc()
    run = Window.partitionBy(*keys).orderBy(time, "__side", ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return a.unionByName(b).withColumn("__v", F.last("__v", ignorenulls=True).over(run)).filter("__side = 1").select(*left.columns, "__v")


def first_within(left: DataFrame, right: DataFrame, keys: list[str], at: str, when: str, value: str, days: int) -> DataFrame:
    """Left rows with the first right ``value`` from ``at`` on, null if later than ``days``."""
    found = _nearest(left, right, keys, at, when, value, True)
    inside = F.col("__v.when") <= F.col(at) + F.expr(f"INTERVAL {days} DAYS")
    return found.select(*left.columns, F.when(inside, F.col("__v.value")).alias(value))


def last_within(left: DataFrame, right: DataFrame, keys: list[str], at: str, when: str, value: str, days: int, accept) -> DataFrame:
    """Left rows with the last right ``value`` up to ``at`` and at most ``days`` old, if accepted."""
    found = _nearest(left, right, keys, at, when, value, False)
    inside = (F.col("__v.when") >= F.col(at) - F.expr(f"INTERVAL {days} DAYS")) & accept(F.col("__v.value"))
    return found.select(*left.columns, F.when(inside, F.col("__v.value")).alias(value))


def interpolate(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Straight line between two known points; the nearer one where the other is missing."""
    line = y0 + (y1 - y0) * (x - x0) / F.nullif(x1 - x0, F.lit(0))
    return F.when(x0.isNull(), y1).when(x1.isNull() | (x1 == x0), y0).otherwise(line)
