"""Landed feeds: raw JSON and pages by endpoint, paged sources, granularity sweeps.

The build reaches no network. What a feed returned lies as files below a landing folder,
``<endpoint>/season=<year>/``; a live feed is a fetch function behind the paged data source.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def endpoint(spark: SparkSession, root: str, name: str, schema: str, season: int | None = None) -> DataFrame:
    """Records of one endpoint, all seasons or one; broken lines are null rows and go."""
    rows = spark.read.schema(f"{schema}, season int, _broken string").option("columnNameOfCorruptRecord", "_broken").json(f"{root}/{name}")
    rows = rows.filter("_broken is null").drop("_broken")
    return rows if season is None else rows.filter(F.col("season") == season)


def pages(spark: SparkSession, root: str) -> DataFrame:
    """path, html of every landed page, one row a file."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").option("recursiveFileLookup", True).load(root)
    return rows.select("path", F.decode("content", "UTF-8").alias("html"))


class _Page(InputPartition):
    def __init__(self, closed: bool, lane: int):
        super().__init__((closed, lane))
        self.closed, self.lane = closed, lane


class PagedReader(DataSourceReader):
    """Reads lanes of offsets: lane i of n takes pages i, i + n, ... until one is short."""

    def __init__(self, fetch: Callable[[bool, int, int], list[tuple]], size: int, lanes: int, states: tuple[bool, ...]):
        self.fetch, self.size, self.lanes, self.states = fetch, size, lanes, states

    def partitions(self) -> list[InputPartition]:
        return [_Page(closed, lane) for closed in self.states for lane in range(self.lanes)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        page = partition.lane
        while True:
            rows = self.fetch(partition.closed, page * self.size, self.size) or []
            yield from rows
            if len(rows) < self.size:
                return
            page += self.lanes


def paged_source(name: str, schema: str, fetch: Callable[[bool, int, int], list[tuple]], size: int = 100, lanes: int = 4) -> type[DataSource]:
    """A data source over ``fetch(closed, offset, limit)``, to be registered under ``name``.

    Open and closed records are asked for explicitly; option ``closed`` picks one of them.
    """

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            wanted = self.options.get("closed")
            states = (False, True) if wanted is None else (wanted.lower() == "true",)
            return PagedReader(fetch, size, lanes, states)

    return Paged


def finest_history(points: DataFrame, key: str, rank: str) -> DataFrame:
    """Of each key's points, those of the first granularity (least ``rank``) that has any."""
    first = points.groupBy(key).agg(F.min(rank).alias("__first"))
    return points.join(first, key).filter(F.col(rank) == F.col("__first")).drop("__first")


def coverage(targets: DataFrame, points: DataFrame, key: str, granularity: str) -> DataFrame:
    """granularity, targets, points; targets without a point are under a null granularity."""
    found = points.groupBy(key, granularity).agg(F.count(F.lit(1)).alias("n"))
    rows = targets.select(key).distinct().join(found, key, "left")
    return rows.groupBy(granularity).agg(F.count_distinct(key).alias("targets"), F.coalesce(F.sum("n"), F.lit(0)).alias("points"))
