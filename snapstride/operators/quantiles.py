"""Exact quantiles of large groups without sorting them in one task.

A mergeable sketch brackets the wanted quantile; rows below the bracket are counted, and only
the rows inside it, a few in ten thousand, are sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000


def _bracket(rows: DataFrame, by: list[str], value: str, low: float, high: float) -> DataFrame:
    edge = F.percentile_approx(value, F.array(F.lit(max(0.0, low - 4 / ACCURACY)), F.lit(min(1.0, high + 4 / ACCURACY))), F.lit(ACCURACY))
    found = rows.groupBy(*by).agg(edge.alias("__e"), F.count(F.lit(1)).alias("__n"), F.min(value).alias("__min"), F.max(value).alias("__max"))
    few = F.col("__n") < 4 * ACCURACY  # the bracket would hold less than a rank on each side
    low, high = F.when(few, F.col("__min")).otherwise(F.col("__e")[0]), F.when(few, F.col("__max")).otherwise(F.col("__e")[1])
    return found.select(*by, low.alias("__low"), high.alias("__high"), "__n")


def _joined(rows: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    # one row a group, and so small next to the groups; a broadcast is left to the optimizer's size check
    return rows.join(found, by) if by else rows.crossJoin(found)


def percentile(rows: DataFrame, by: list[str], value: str, q: float, name: str) -> DataFrame:
    """``by``, ``name``: the value at rank q of each group, linear between two rows; nulls are not counted."""
    rows = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"))
    marked = _joined(rows, _bracket(rows, by, "__v", q, q), by)
    below = marked.groupBy(*by).agg(F.count_if(F.col("__v") < F.col("__low")).alias("__below"), F.first("__n").alias("__n"))
    inside = marked.filter("__v >= __low and __v <= __high").groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__c"))
    run = Window.partitionBy(*by).orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = _joined(inside.withColumn("__upto", F.sum("__c").over(run)), below, by)
    at = (F.col("__n") - 1) * q
    upto = F.col("__below") + F.col("__upto")  # ranks below this one are at most this value
    lower = F.min(F.when(upto > F.floor(at), F.col("__v")))
    upper = F.min(F.when(upto > F.ceil(at), F.col("__v")))
    part = F.first(at - F.floor(at))
    return ranked.groupBy(*by).agg((lower + (upper - lower) * part).alias(name))


def weighted(rows: DataFrame, by: list[str], value: str, weight: str, q: float, name: str, parts: int = 256) -> DataFrame:
    """``by``, ``name``, n_eff: the least value up to which ``weight`` reaches q of its group's sum.

    n_eff is Kish's effective number of rows. The sketch, of values only, cuts each group into
    parts; weights are summed by part, and only the part that holds the answer is sorted.
    """
    rows = rows.select(*by, F.col(value).alias("__v"), F.col(weight).alias("__w")).filter("__v is not null")
    cuts = rows.groupBy(*by).agg(F.percentile_approx("__v", F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(ACCURACY)).alias("__cuts"))
    placed = _joined(rows, cuts, by).withColumn("__part", F.size(F.filter("__cuts", lambda c: c < F.col("__v")))).drop("__cuts")
    sums = placed.groupBy(*by, "__part").agg(F.sum("__w").alias("__s"), F.sum(F.col("__w") * F.col("__w")).alias("__s2"))
    run = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    sums = sums.withColumn("__upto", F.sum("__s").over(run)).withColumn("__all", F.sum("__s").over(whole)).withColumn("n_eff", F.pow("__all", F.lit(2)) / F.sum("__s2").over(whole))
    hit = sums.filter(F.col("__upto") >= q * F.col("__all") * (1 - 1e-12)).groupBy(*by).agg(F.min_by(F.struct("__part", (F.col("__upto") - F.col("__s")).alias("__before"), "__all", "n_eff"), "__part").alias("__h"))
    inner = placed.join(hit.select(*by, "__h.*"), [*by, "__part"]).groupBy(*by, "__v", "__before", "__all", "n_eff").agg(F.sum("__w").alias("__w"))
    upto = F.col("__before") + F.sum("__w").over(Window.partitionBy(*by).orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    reached = upto >= q * F.col("__all") * (1 - 1e-12)
    inner = inner.withColumn("__r", reached)
    return inner.groupBy(*by, "n_eff").agg(F.coalesce(F.min(F.when(F.col("__r"), F.col("__v"))), F.max("__v")).alias(name))
