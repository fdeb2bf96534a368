"""Mixing sources to target weights, in DataFrame functions only.

Within a source, documents are ordered by Efraimidis-Spirakis keys: with u uniform in
(0, 1) from the document id and q its quality weight, u^(1/q) descending is a weighted
random order without replacement. A source whose target is e times its size gives floor(e)
complete epochs and then the documents at the front of that order until the rest is met.

A running sum over a whole source would put a hot source into one task. The keys therefore
fall into equal ranges, about one for each BUCKET_ROWS documents; sums by (source, bucket)
give what stands before each bucket, and only the running sum inside a bucket touches
documents. The order, and so the mix, does not depend on the number of ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import free_name, row_keys, staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BUCKET_ROWS = 4096
LEAST_BUCKETS, MOST_BUCKETS = 64, 1 << 20


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def letter_share(text: Column) -> Column:
    """The quality weight: one plus the share of letters and blanks in the text."""
    whole = F.length(text)
    good = F.length(F.regexp_replace(text, r"[^\p{L} ]", ""))
    return F.lit(1.0) + F.coalesce(F.when(whole > 0, good / whole), F.lit(0.0))


def uniform(id_col: Column) -> Column:
    """In (0, 1), from the first 52 bits of the md5 of the id as text."""
    digits = F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit(""))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def source_key(source: Column) -> Column:
    """``=`` and the source; empty for null, so that joins and windows need no null test."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def source_name(key: Column) -> Column:
    return F.when(key != "", key.substr(F.lit(2), F.length(key)))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source (as by source_key), source_size -> also weight and target; one row per source.

    Targets share ``share`` of all sizes by weight; none exceeds ``most`` times its source,
    and the excess is shared again by weight. That is min(cap, level * weight) for one level,
    found by sorting the sources by cap / weight: those below the level are full. With the
    sources before one full, the rest would stand at ``level``; of those that can hold it,
    the first has the greatest, which is the answer.
    """
    order = Window.orderBy(F.col("source") == "", "source")
    picked = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", picked).withColumn("cap", F.col("source_size") * F.lit(most))
    whole = Window.partitionBy(F.lit(0))
    full = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source") == "", "source").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("goal", F.sum("source_size").over(whole) * F.lit(share))
    rows = rows.withColumn("level", (F.col("goal") - F.coalesce(F.sum("cap").over(full), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(full), F.lit(0.0))))
    fits = F.col("cap") >= F.col("level") * F.col("weight")
    rows = rows.withColumn("level", F.max(F.when(fits, F.col("level"))).over(whole))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return rows.select("source", "source_size", "weight", F.round(target, 6).alias("target"))


def plan_mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: Column | None = None,
    weights=WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    buckets: int | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    ``copies`` is how often the mix holds the document and ``taken`` its words times that.
    The document at the border of the fractional part is taken if at least half of it fits,
    so a source misses its target by at most half of one document. Defined cases: a null
    text has size 0 and is never part of the fractional selection; null sources are one
    source, ordered last; rows that repeat a doc_id are separate documents in a fixed
    order; an empty table gives no rows; reruns agree, as keys come from ids.
    """
    text = F.col(text_col)
    key = F.pow(uniform(F.col(id_col)), F.lit(1.0) / (letter_share(text) if quality is None else quality))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        source_key(F.col(source_col)).alias("source"),
        n_words(text).alias("size"),
        F.round(key, 12).alias("key"),
    )
    rows = staged(rows, "mixkeys")
    if buckets is None:
        buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, rows.count() // BUCKET_ROWS))
    # equal ranges of 1 - key, so that bucket 0 is taken first
    rows = rows.withColumn("bucket", F.least(F.lit(buckets - 1), F.floor((1 - F.col("key")) * buckets)).cast("int"))

    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    sizes = sums.groupBy("source").agg(F.sum("sum").alias("source_size"))
    aims = targets(sizes, weights, share, most)
    before = F.sum("sum").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("sum")
    marks = sums.withColumn("before", before).alias("s").join(aims.alias("a"), F.col("s.source") == F.col("a.source"))
    marks = marks.select("s.source", "bucket", "before", "source_size", "target")
    marks = marks.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    marks = marks.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))

    inner = Window.partitionBy("d.source", "d.bucket").orderBy(F.col("d.key").desc(), "d.doc_id", "d.size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.alias("d").join(marks.alias("m"), (F.col("d.source") == F.col("m.source")) & (F.col("d.bucket") == F.col("m.bucket")))
    upto = F.col("before") + F.sum("d.size").over(inner)
    chosen = (F.col("d.size") > 0) & (upto - F.col("d.size") / 2 <= F.col("rest"))
    copies = F.col("epochs") + F.when(chosen, F.lit(1)).otherwise(F.lit(0))
    planned = joined.select("d.doc_id", source_name(F.col("d.source")).alias("source"), "d.size", "m.source_size", "m.target", copies.cast("long").alias("copies"))
    return planned.withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def mixed(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` as often as ``plan_mix`` takes them: not at all, once or more.

    Defined cases: as ``plan_mix``; rows that repeat an id, or have none, are planned row by
    row, by a number that the rows get in the order in which they are read.
    """
    rows, key = row_keys(docs, id_col)
    mine, copies, copy = (free_name(rows, x) for x in ("mix_id", "mix_copies", "mix_copy"))
    plan = plan_mix(rows, id_col=key, **options).select(F.col("doc_id").alias(mine), F.col("copies").alias(copies)).filter(F.col(copies) > 0)
    taken = rows.join(plan.hint("merge"), rows[key] == plan[mine])
    repeated = taken.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])
