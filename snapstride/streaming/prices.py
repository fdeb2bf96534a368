"""Structured Streaming forms of the incremental steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import upsert


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """The whole versions below ``folder``, ascending: those whose success marker is written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/v*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(x.getPath().getParent().getName()[1:]) for x in (found or []))


def upsert_stream(rows: DataFrame, folder: str, keys: list[str], order: list[str], checkpoint: str, kept: int = 2, parts: int = 64) -> StreamingQuery:
    """Folds each micro-batch into the keyed table below ``folder``, one version a batch.

    The table is split into ``parts`` by key, and a batch writes only the parts that its keys
    are in: a version is the list of folders its parts are read from. A batch reads the version
    before it and writes its own, so a batch that runs again after a failure gives the same
    version. Folders that none of the last ``kept`` versions reads are deleted. Processes what is
    there, then stops.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")).persist()
        touched = {r.part for r in batch.select("part").distinct().collect()}  # at most ``parts``
        before = _manifest(spark, folder, number)
        old = _read(spark, {k: v for k, v in before.items() if k in touched}, folder, batch.schema)
        new = upsert(old, batch, [*keys, "part"], order).withColumn("version", F.lit(number))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "version").parquet(f"{folder}/data")
        batch.unpersist()
        now = {**before, **{k: number for k in touched}}
        spark.createDataFrame(sorted(now.items()), "part int, version int").coalesce(1).write.mode("overwrite").json(f"{folder}/v{number}")
        _tidy(spark, folder, kept)

    return rows.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _parts_of(spark: SparkSession, folder: str, version: int) -> dict[int, int]:
    """part -> the version that wrote it, as this version reads the table."""
    return {r.part: r.version for r in spark.read.schema("part int, version int").json(f"{folder}/v{version}").collect()}


def _manifest(spark: SparkSession, folder: str, below: int | None = None) -> dict[int, int]:
    """The parts of the last version (below a number)."""
    found = [v for v in _versions(spark, folder) if below is None or v < below]
    return _parts_of(spark, folder, found[-1]) if found else {}


def _read(spark: SparkSession, manifest: dict[int, int], folder: str, schema: T.StructType) -> DataFrame:
    """The rows of a manifest, with their part: only its folders are read."""
    if not manifest:
        return spark.createDataFrame([], schema)
    own = [f for f in schema.fields if f.name != "part"]
    kinds = T.StructType([*own, T.StructField("part", T.IntegerType()), T.StructField("version", T.IntegerType())])
    wanted = [(F.col("part") == k) & (F.col("version") == v) for k, v in manifest.items()]
    return spark.read.schema(kinds).parquet(f"{folder}/data").filter(reduce(lambda a, b: a | b, wanted)).select(*[f.name for f in schema.fields])


def _tidy(spark: SparkSession, folder: str, kept: int) -> None:
    """Deletes what only versions before the last ``kept`` read, and these versions."""
    found = _versions(spark, folder)
    used = {x for n in found[-kept:] for x in _parts_of(spark, folder, n).items()}
    old = {x for n in found[:-kept] for x in _parts_of(spark, folder, n).items()} - used
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = hadoop(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for path in [f"data/part={k}/version={v}" for k, v in old] + [f"v{n}" for n in found[:-kept]]:
        store.delete(hadoop(f"{folder}/{path}"), True)


def latest_version(spark: SparkSession, folder: str, query: StreamingQuery, schema: T.StructType) -> DataFrame:
    """The table after the query has ended, as its last version is, also if this run had no batch.

    schema: that of the streamed rows.
    """
    query.awaitTermination()
    full = T.StructType([*schema.fields, T.StructField("part", T.IntegerType())])
    return _read(spark, _manifest(spark, folder), folder, full).drop("part")


def sealed_prices(orders: DataFrame, ticks: DataFrame, tolerance: str = "3 days") -> DataFrame:
    """Ticks from an order's time on, within the tolerance, as a stream-stream interval join.

    orders: candidate, at; ticks: candidate, ts, price. The watermarks bound the state to the
    tolerance; the first tick of an order is the first row of it that a sink sees in time order.
    """
    o = orders.withWatermark("at", tolerance).alias("o")
    t = ticks.withWatermark("ts", tolerance).alias("t")
    on = F.expr(f"o.candidate = t.candidate AND t.ts >= o.at AND t.ts <= o.at + INTERVAL {tolerance}")
    return o.join(t, on).select("o.candidate", "o.at", "t.ts", "t.price")


def daily_bars(ticks: DataFrame, late: str = "1 day") -> DataFrame:
    """Open, close, low and high of each candidate's day; days close ``late`` after their end."""
    day = F.window("ts", "1 day")
    at = F.struct("ts", "price")
    bars = ticks.withWatermark("ts", late).groupBy("candidate", day.alias("w"))
    return bars.agg(F.min_by("price", "ts").alias("open"), F.max_by("price", at).alias("close"), F.min("price").alias("low"), F.max("price").alias("high")).select("candidate", F.col("w.start").alias("day"), "open", "close", "low", "high")


def reversal_streaks(targets: DataFrame, confirm: int = 2) -> DataFrame:
    """Per candidate, the side held after each fair-value snapshot of (candidate, snapshot, side).

    A new side is taken only when it came ``confirm`` snapshots in a row; the state of a
    candidate is (side held, side seen, streak).
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, seen, streak = state.get if state.exists else (0, 0, 0)
        out = []
        for part in parts:
            for snapshot, side in part.sort_values("snapshot")[["snapshot", "side"]].itertuples(index=False):
                streak = streak + 1 if side == seen else 1
                seen = int(side)
                if held == 0 or seen == held or streak >= confirm:
                    held = seen
                out.append((key[0], int(snapshot), held))
        state.update((held, seen, streak))
        yield pd.DataFrame(out, columns=["candidate", "snapshot", "held"])

    return targets.groupBy("candidate").applyInPandasWithState(step, "candidate long, snapshot long, held int", "held int, seen int, streak int", "append", "NoTimeout")


def replay(spark: SparkSession, path: str, schema, transform: Callable[[DataFrame], DataFrame] = lambda df: df, files: int = 1) -> DataFrame:
    """A stream over the files that match ``path``, ``files`` to a batch."""
    return transform(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path))
