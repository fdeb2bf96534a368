"""The concepts of the as-of pipeline over the driver's tables, for Spark and for DuckDB.

supplier stands for a candidate, lineitem for the game log (year for season, return flag for
award), events for price ticks, embeddings for raw ensemble scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table

#: value / (value + PRICE_HALF) makes an event's value a price in (0, 1)
PRICE_HALF = 50.0


def game_log(spark: SparkSession, sf: str) -> DataFrame:
    """One row per line; points are whole, so sums of them are exact in any order."""
    d = F.to_date("l_shipdate")
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("player_id"),
        d.alias("game_date"),
        F.year(d).alias("season"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.col("l_quantity").alias("minutes"),
        F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("points"),
        F.col("l_returnflag").alias("award"),
    )


def player(spark: SparkSession, sf: str) -> DataFrame:
    """player_id, name, position (the region); small dimensions are joined first."""
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf, "supplier").join(nation.select("n_nationkey", "r_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("s_suppkey").alias("player_id"), F.col("s_name").alias("name"), F.col("r_name").alias("position"))


def grid(log: DataFrame) -> DataFrame:
    """Month-end snapshots of each season: season, snapshot_date, week_index, kind."""
    days = log.select("season", F.last_day("game_date").alias("snapshot_date")).distinct()
    month = F.month("snapshot_date")
    return days.withColumn("week_index", month - 1).withColumn("kind", F.when(month == 12, "ratings").otherwise("weekly"))


def box_asof(log: DataFrame) -> DataFrame:
    """Season-to-date totals at each snapshot: gp, points, minutes, and their means.

    Games are summed by month first; the running window then sees at most twelve rows a
    player and season instead of joining snapshots to games.
    """
    months = log.groupBy("player_id", "season", F.last_day("game_date").alias("snapshot_date")).agg(
        F.count(F.lit(1)).alias("gp"), F.sum("points").alias("points"), F.sum("minutes").alias("minutes")
    )
    spots = months.select("player_id", "season").distinct().join(grid(log).select("season", "snapshot_date"), "season")
    so_far = Window.partitionBy("player_id", "season").orderBy("snapshot_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = spots.join(months, ["player_id", "season", "snapshot_date"], "left")
    sums = filled.select("player_id", "season", "snapshot_date", *[F.sum(c).over(so_far).alias(c) for c in ("gp", "points", "minutes")])
    return sums.filter("gp is not null").withColumn("pts", F.col("points") / F.col("gp")).withColumn("mpg", F.col("minutes") / F.col("gp"))


def award_voting(log: DataFrame) -> DataFrame:
    """season, award, player_id, revenue, vote_share, rank, won, votes."""
    sums = log.groupBy("season", "award", "player_id").agg(F.sum("points").alias("revenue"), F.count_if(F.col("minutes") >= 40).alias("votes"))
    race = Window.partitionBy("season", "award")
    rank = F.row_number().over(race.orderBy(F.col("revenue").desc(), "player_id"))
    rows = sums.withColumn("vote_share", F.col("revenue") / F.sum("revenue").over(race)).withColumn("rank", rank)
    return rows.withColumn("won", (F.col("rank") == 1).cast("int"))


def ticks(spark: SparkSession, sf: str, kind: str | None = None) -> DataFrame:
    rows = table(spark, sf, "events")
    rows = rows.filter(F.col("event_type") == kind) if kind else rows
    price = F.col("value") / (F.col("value") + PRICE_HALF)
    return rows.select(F.col("user_id").alias("candidate"), "ts", price.alias("price"), "event_id", "event_type")


def daily_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Last price of each (candidate, day) with its ordinal in the candidate's series."""
    rows = ticks(spark, sf).withColumn("day", F.to_date("ts"))
    days = rows.groupBy("candidate", "day").agg(F.max_by("price", F.struct("ts", "event_id")).alias("price"))
    return days.withColumn("i", F.row_number().over(Window.partitionBy("candidate").orderBy("day")))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """group, candidate, raw (K scores as doubles); the least candidate of a group won."""
    rows = table(spark, sf, "embeddings").select(
        F.col("label").alias("grp"), F.col("vec_id").alias("candidate"), F.transform("embedding", lambda x: x.cast("double")).alias("raw")
    )
    won = F.min("candidate").over(Window.partitionBy("grp")) == F.col("candidate")
    return rows.withColumn("won", won.cast("int"))


#: The same for DuckDB, as common table expressions; each may use those before it.
CTES = {
    "game_log": """SELECT l_suppkey AS player_id, CAST(l_shipdate AS DATE) AS game_date,
  CAST(year(l_shipdate) AS INT) AS season, l_orderkey, l_linenumber, l_partkey, l_quantity AS minutes,
  CAST(floor(l_extendedprice * (1 - l_discount)) AS BIGINT) AS points, l_returnflag AS award FROM lineitem""",
    "player": """SELECT s_suppkey AS player_id, s_name AS name, r_name AS position
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "grid": """SELECT DISTINCT season, last_day(game_date) AS snapshot_date, CAST(month(last_day(game_date)) - 1 AS INT) AS week_index,
  CASE WHEN month(last_day(game_date)) = 12 THEN 'ratings' ELSE 'weekly' END AS kind FROM game_log""",
    "box": """SELECT g.player_id, s.season, s.snapshot_date, count(*) AS gp, sum(points) AS points, sum(minutes) AS minutes,
  sum(points) / count(*) AS pts, sum(minutes) / count(*) AS mpg
  FROM game_log g JOIN grid s ON g.season = s.season AND g.game_date <= s.snapshot_date
  GROUP BY g.player_id, s.season, s.snapshot_date""",
    "voting": """SELECT *, revenue / sum(revenue) OVER (PARTITION BY season, award) AS vote_share,
  row_number() OVER (PARTITION BY season, award ORDER BY revenue DESC, player_id) AS rank,
  CAST(row_number() OVER (PARTITION BY season, award ORDER BY revenue DESC, player_id) = 1 AS INT) AS won
  FROM (SELECT season, award, player_id, sum(points) AS revenue, count(*) FILTER (WHERE minutes >= 40) AS votes
        FROM game_log GROUP BY season, award, player_id)""",
    "ticks": """SELECT user_id AS candidate, ts, value / (value + 50e0) AS price, event_id, event_type FROM events""",
    "daily": """SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY day) AS i FROM (
  SELECT candidate, CAST(ts AS DATE) AS day, arg_max(price, (ts, event_id)) AS price FROM ticks GROUP BY 1, 2)""",
    "scores": """SELECT label AS grp, vec_id AS candidate, CAST(embedding AS DOUBLE[]) AS raw,
  CAST(min(vec_id) OVER (PARTITION BY label) = vec_id AS INT) AS won FROM embeddings""",
    "draws": """SELECT grp, candidate, won, generate_subscripts(raw, 1) AS k, unnest(raw) AS s FROM scores""",
}

_NEEDS = {"grid": ["game_log"], "box": ["game_log", "grid"], "voting": ["game_log"], "daily": ["ticks"], "draws": ["scores"]}


def with_roles(*names: str, more: str = "") -> str:
    """A WITH clause of these roles and what they need, then ``more`` expressions."""
    order: list[str] = []

    def need(name: str) -> None:
        for x in _NEEDS.get(name, []):
            need(x)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    parts = [f"{n} AS ({CTES[n]})" for n in order]
    return "WITH " + ", ".join(parts + ([more] if more else [])) + " "
