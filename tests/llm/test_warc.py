import io
import random
import zlib

import pytest
from pyspark.sql import functions as F

from snapstride.llm import warc


@pytest.fixture(scope="module")
def pages(spark):
    from snapstride.llm.queries import prepared

    prepared(spark)
    html = ["<p>é\r\n\r\nWARC/1.1</p>", None, "", "<p>same</p>", "<p>same</p>", "<p>same</p>", "x" * 300_000]
    rows = [(i, None if i == 2 else f"https://www.Site{i % 3}.org/a?b={i % 2}\n", h) for i, h in enumerate(html)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))


def wanted(rows):
    groups = {}
    for p, h in rows:
        groups.setdefault((h or "").encode(), []).append(p)
    return {(p, len(h), warc.payload_digest(h), "response" if p == max(g) else "revisit", None if p == max(g) else max(g)) for h, g in groups.items() for p in g}


def test_round_trip(pages, spark):
    for df in (pages.repartition(3), spark.read.parquet("/root/testdata/sf0.01/pages.parquet")):
        rows = warc.archive_round_trip(df).collect()
        assert {tuple(r)[:5] for r in rows} == wanted([(r.page_id, r.html) for r in df.collect()])
        ordered = [(r.url_key, r.captured, r.page_id) for r in sorted(rows, key=lambda r: r.merged)]
        assert ordered == sorted(ordered) and len({r.merged for r in rows}) == len(rows)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_runs_merge_from_blocks_and_spilled_runs(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").repartition(6)
    whole = {r.page_id: tuple(r)[:7] for r in warc.archive_round_trip(df).collect()}
    rows = warc.archive_round_trip(df, run_rows=20, range_rows=150, fan_in=3).collect()
    assert {r.page_id: tuple(r)[:7] for r in rows} == whole and len(rows) == len(whole)
    rows.sort(key=lambda r: r.merged)
    ordered = [(r.url_key, r.captured, r.page_id, r.archive, r.place) for r in rows]
    assert ordered == sorted(ordered) and len({r.merged >> 40 for r in rows}) > 4


def test_a_merge_holds_one_block_of_each_run(tmp_path):
    read, folder = [], tmp_path.as_uri()
    keyed = sorted([(i, f"k{i % 50:02d}", "t", 1, "d", "response", None, "a", i) for i in range(3000)], key=warc.order_of)
    names = [list(warc.write_run(iter(keyed[i::4]), folder, 64))[0][0] for i in range(4)]

    def stream(i):
        for row in warc.read_run(names[i], list(range(12))):
            read.append(i)
            yield row

    got = warc.merged([lambda i=i: stream(i) for i in range(4)], folder)
    assert [next(got) for _ in range(10)] == keyed[:10] and len(read) <= 14
    assert list(got) == keyed[10:]


def test_small_payloads_can_stay_responses(pages):
    kinds = {r.page_id: r.record_type for r in warc.archive_round_trip(pages, least_bytes=12).collect()}
    assert set(kinds.values()) == {"response"}


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "u", "a"), (3, "u", "a"), (3, "u", "a"), (None, "u", "b")], "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.archive_round_trip(df).collect())
    assert got == [("3", "response", None), ("3", "response", None), ("None", "response", None), ("None", "revisit", 3)]


def test_members_are_found_at_any_read_size():
    records = [warc.record(i, f"http://h/{i}", bytes([i]) * i * 50, "D", None) for i in range(6)]
    blob, places = b"", []
    for r in records:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        places.append(len(blob))
        blob += z.compress(r) + z.flush()
    for step in (1, 7, 1000):
        assert list(warc.read_members(io.BytesIO(blob), step)) == list(zip(places, records))
    with pytest.raises(ValueError):
        list(warc.read_members(io.BytesIO(blob[:-3])))
    with pytest.raises(ValueError):
        warc.parse_record(records[3][:-6] + b"\r\n\r\n")


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(rng.choices(range(20), k=rng.randrange(12))) for _ in range(k)]
    assert list(warc.loser_tree([iter(r) for r in runs], lambda x: (x,))) == sorted(x for r in runs for x in r)


def test_url_key():
    assert warc.url_key("https://www.Example.org/A?b") == "org,example)/a?b"
    assert warc.url_key(None) == warc.url_key("") == ""
    assert warc.url_key("http://[bad") == "http://[bad"
