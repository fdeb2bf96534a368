"""Keyed tables on Parquet: upsert, work lists, fill-null updates, cached results, sinks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key.

    Of new rows with one key the greatest ``order`` counts. Both sides must have the same
    columns. A table that is keys alone keeps its old row. One shuffle by key.
    """
    if set(old.columns) != set(new.columns):
        raise ValueError(f"columns differ: {sorted(set(old.columns) ^ set(new.columns))}")
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    newest = Window.partitionBy(*keys).orderBy(F.col("__new").desc(), *[F.col(c).desc() for c in order])
    return both.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n", "__new")


def work_list(spark: SparkSession, done: DataFrame, kind: str, floor: int, current: int) -> DataFrame:
    """Seasons from ``current`` down to ``floor`` that ``done`` (pull_type, season) lacks."""
    every = spark.range(floor, current + 1).select(F.col("id").cast("int").alias("season"))
    return every.join(done.filter(F.col("pull_type") == kind).select("season"), "season", "left_anti").orderBy(F.col("season").desc())


def residual(done: DataFrame, kind: str) -> DataFrame:
    """Seasons that ended with failures, latest first."""
    return done.filter((F.col("pull_type") == kind) & (F.col("n_failed") > 0)).select("season").orderBy(F.col("season").desc())


def mark_complete(done: DataFrame, kind: str, found: DataFrame) -> DataFrame:
    """``done`` with the seasons of ``found`` (season, n_failed) marked, a repeat in place of the old mark."""
    marks = found.select(F.lit(kind).alias("pull_type"), "season", F.col("n_failed").cast("long").alias("n_failed"))
    return upsert(done.select("pull_type", "season", F.col("n_failed").cast("long").alias("n_failed")), marks, ["pull_type", "season"], ["n_failed"])


def utc_stamp(rows: DataFrame, column: str, at: str | None = None) -> DataFrame:
    """``rows`` with one ISO stamp in UTC, to the second: ``at`` where a rerun has to agree, else now."""
    when = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
    return rows.withColumn(column, F.date_format(F.to_utc_timestamp(when, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def latest_selection(registry: DataFrame, award: str, number: str, kept: str) -> DataFrame:
    """award, number, place, column_name of each award's greatest number; ``kept`` is a JSON list."""
    last = registry.groupBy(award).agg(F.max_by(F.struct(number, kept), number).alias("last"))
    names = F.from_json(F.col(f"last.{kept}"), "array<string>")
    return last.select(award, F.col(f"last.{number}").alias(number), F.posexplode(names).alias("place", "column_name"))


def keep_columns(rows: DataFrame, wanted: list[str], always: Iterable[str] = ()) -> DataFrame:
    """The ``wanted`` columns, and those of ``always`` that are there; raises if one is missing."""
    missing = [c for c in wanted if c not in rows.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    return rows.select(*wanted, *[c for c in always if c in rows.columns and c not in wanted])


def fill_null(rows: DataFrame, found: DataFrame, key: str, column: str) -> DataFrame:
    """``rows`` with ``column`` from ``found`` where it is null."""
    other = found.select(key, F.col(column).alias("__found"))
    return rows.join(other, key, "left").withColumn(column, F.coalesce(column, "__found")).drop("__found")


def add_columns(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Null columns for those of ``kinds`` that are missing; those present stay as they are."""
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in rows.columns})


def union_rows(frames: Iterable[DataFrame]) -> DataFrame:
    """All rows under the ordered union of the columns; what a frame lacks is null."""
    first, *rest = frames
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def write_csv(rows: DataFrame, path: str) -> None:
    """With a header, null as blank; arrays and maps as JSON."""
    nested = {f.name: F.to_json(f.name) for f in rows.schema.fields if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)}
    rows.withColumns(nested).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line, nulls among its fields."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def cached(spark: SparkSession, folder: str, parts: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The table under the digest of ``parts``; built and written if it is not there.

    The committer's success marker is written last, so a broken run is not taken for a result.
    """
    name = hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:24]
    path = f"{folder}/{name}"
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def only_winner(labels: DataFrame, group: list[str]) -> DataFrame:
    """The winner of each group; raises if a group has none or several."""
    counts = labels.groupBy(*group).agg(F.sum("won").alias("n"), F.max(F.when(F.col("won") == 1, F.col("player_id"))).alias("winner"))
    message = F.concat(F.lit("not one winner in "), F.concat_ws("|", *[F.col(c).cast("string") for c in group]))
    return counts.select(*group, F.when(F.col("n") == 1, F.col("winner")).otherwise(F.raise_error(message)).alias("winner"))


def refuse_sealed(award: str, season: int, sealed: dict[str, set[int]], default: frozenset[int] = frozenset({2024, 2025})) -> None:
    """Raises for a season that is held out for this award."""
    if season in sealed.get(award, default):
        raise ValueError(f"{award} {season} is sealed")
