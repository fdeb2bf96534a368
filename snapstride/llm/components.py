"""Connected components of a table of links, without ever holding it in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .scratch import staged

#: A key of more rows than this, and than one in MOST_HUBS of all, is split SALTS ways.
HUB = 1 << 17
MOST_HUBS = 100_000
SALTS = 32


def _look_up(left: DataFrame, right: DataFrame, key: str, other: str, bar: int | None) -> DataFrame:
    """``left`` joined with ``right``, which has one row a key; hot keys of ``left`` are salted.

    Keys of more than ``bar`` rows are so few that they can be broadcast: at most MOST_HUBS.
    """
    if bar is None:
        return left.join(right.hint("merge"), key)
    hot = left.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bar).select(key, F.lit(True).alias("hot"))
    spread = F.when(F.col("hot"), F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).otherwise(0)
    copies = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    rows = left.join(F.broadcast(hot), key, "left").withColumn("salt", spread).drop("hot")
    once = right.join(F.broadcast(hot), key, "left").withColumn("salt", F.explode(copies)).drop("hot")
    return rows.join(once, [key, "salt"]).drop("salt")


def connected(links: DataFrame) -> DataFrame:
    """(a, b) links -> (id, label) for every id of a link; label is the component's least id.

    Each round, an id and the id it is labelled with both take the least label that the ids
    next to it are labelled with at two removes; labels are cut short by one remove. Trees of
    labels are so hung below one another at their roots, and a path of n links takes about
    log n rounds whatever the order of its ids. A round is one job, written to the shared
    folder. Minima are taken in part before each shuffle; the two look-ups of a round would
    gather the links of a hub, and the members of a large component, so these are salted.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = staged(both, "edges")
    edges = both.count()
    bar = max(HUB, edges // MOST_HUBS) if edges > HUB else None
    labels = staged(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        roots = _look_up(labels, labels.select(F.col("id").alias("label"), F.col("label").alias("root")), "label", "id", bar)
        near = _look_up(both, roots.select(F.col("id").alias("b"), "root"), "b", "a", bar).groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        own = F.struct("id", F.least("label", "root", "near").alias("label"), F.col("label").alias("was"))
        hung = F.struct(F.col("label").alias("id"), F.col("near").alias("label"), F.lit(None).cast("long").alias("was"))
        step = roots.join(near, "id").select(F.inline(F.array(own, hung))).groupBy("id").agg(F.min("label").alias("label"), F.max("was").alias("was"))
        seen = Observation()
        step = step.observe(seen, F.count_if(F.col("label") != F.col("was")).alias("moved"))
        labels = staged(step.select("id", "label"), "labels")
        if not seen.get["moved"]:
            return labels
