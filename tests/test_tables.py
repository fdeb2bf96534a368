import pytest
from pyspark.sql import functions as F

from snapstride.session import shared_dir
from snapstride.sources import tables
from snapstride.streaming import prices


def test_upsert_replaces_and_keeps(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, seq int")
    new = spark.createDataFrame([("x", 2, 1), ("y", 2, 2), ("z", 3, 1)], "v string, k int, seq int")
    got = {r.k: r.v for r in tables.upsert(old, new, ["k"], ["seq"]).collect()}
    assert got == {1: "a", 2: "y", 3: "z"}
    with pytest.raises(ValueError):
        tables.upsert(old, new.drop("v"), ["k"], ["seq"])


def test_cache_builds_once(spark):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    folder = shared_dir(spark, "cache")
    for _ in range(2):
        assert tables.cached(spark, folder, {"season": 1, "seed": 2}, build).count() == 3
    assert tables.cached(spark, folder, {"season": 2, "seed": 2}, build).count() == 3
    assert len(built) == 2


def test_added_columns_and_ordered_union(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, 3)], "y int, x int")
    assert tables.add_columns(a, {"x": "string", "z": "double"}).dtypes == [("x", "int"), ("z", "double")]
    assert tables.union_rows([a, b]).columns == ["x", "y"]


def test_two_winners_raise(spark):
    labels = spark.createDataFrame([("A", 1, 1), ("A", 2, 1)], "award string, player_id int, won int")
    with pytest.raises(Exception, match="not one winner"):
        tables.only_winner(labels, ["award"]).collect()
    with pytest.raises(ValueError):
        tables.refuse_sealed("MVP", 2025, {})


def test_stream_upsert_over_batches_equals_one_upsert(spark):
    src = shared_dir(spark, "src")
    for part in range(3):
        spark.range(30).coalesce(1).select((F.col("id") % 7).alias("k"), (F.col("id") + 100 * part).alias("seq")).write.mode("append").parquet(src)
    rows = prices.replay(spark, src, spark.read.parquet(src).schema)
    folder, checkpoint = shared_dir(spark, "latest"), shared_dir(spark, "ck")

    def run():
        return prices.latest_version(spark, folder, prices.upsert_stream(rows, folder, ["k"], ["seq"], checkpoint), rows.schema)

    wanted = {(k, 200 + max(i for i in range(30) if i % 7 == k)) for k in range(7)}
    assert {(r.k, r.seq) for r in run().collect()} == wanted
    assert {(r.k, r.seq) for r in run().collect()} == wanted  # a restart without new data
    spark.range(2).select(F.lit(3).cast("long").alias("k"), (F.col("id") + 900).alias("seq")).coalesce(1).write.mode("append").parquet(src)
    assert {(r.k, r.seq) for r in run().collect()} == {*(x for x in wanted if x[0] != 3), (3, 901)}
    assert len(prices._versions(spark, folder)) == 2  # older ones are gone


def _drain(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", shared_dir(spark, "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_interval_join_and_bars(spark):
    ticks = spark.createDataFrame([(1, "2024-01-02 00:00:00", 0.2), (1, "2024-01-02 05:00:00", 0.3), (1, "2024-01-09 00:00:00", 0.9), (1, "2024-01-20 00:00:00", 0.5)], "candidate long, ts string, price double").withColumn("ts", F.to_timestamp("ts"))
    orders = spark.createDataFrame([(1, "2024-01-02 00:00:00")], "candidate long, at string").withColumn("at", F.to_timestamp("at"))
    a, b = shared_dir(spark, "ticks"), shared_dir(spark, "orders")
    ticks.coalesce(1).write.parquet(a)
    orders.coalesce(1).write.parquet(b)
    joined = prices.sealed_prices(prices.replay(spark, b, orders.schema), prices.replay(spark, a, ticks.schema))
    assert sorted(r.price for r in _drain(spark, joined, "sealed")) == [0.2, 0.3]
    bars = _drain(spark, prices.daily_bars(prices.replay(spark, a, ticks.schema)), "bars")
    first = min(bars, key=lambda r: r.day)
    assert (first.open, first.close, first.low, first.high) == (0.2, 0.3, 0.2, 0.3)


def test_streak_state(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate([1, -1, 1, -1, -1, -1])], "candidate long, snapshot long, side int")
    path = shared_dir(spark, "sides")
    rows.coalesce(1).write.parquet(path)
    got = _drain(spark, prices.reversal_streaks(prices.replay(spark, path, rows.schema)), "streaks")
    assert [r.held for r in sorted(got, key=lambda r: r.snapshot)] == [1, 1, 1, 1, -1, -1]


def test_landed_and_paged_sources(spark, tmp_path):
    from snapstride.sources import landing

    folder = tmp_path / "logs" / "season=2023"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text('{"id": 1, "pts": 2.5}\n{broken\n{"id": 2}\n')
    rows = landing.endpoint(spark, f"file://{tmp_path}", "logs", "id long, pts double").collect()
    assert sorted((r.id, r.pts, r.season) for r in rows) == [(1, 2.5, 2023), (2, None, 2023)]

    def fetch(closed, offset, limit):
        every = list(range(250 if closed else 100))
        return [(i, closed) for i in every[offset : offset + limit]]

    spark.dataSource.register(landing.paged_source("paged_test", "id long, closed boolean", fetch, lanes=3))
    assert spark.read.format("paged_test").load().groupBy("closed").count().orderBy("closed").collect() == [(False, 100), (True, 250)]
    assert spark.read.format("paged_test").option("closed", "true").load().count() == 250
