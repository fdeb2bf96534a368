"""WARC archives of pages, and a global index by external merging.

Pages are written as WARC records, one gzip member each; of equal payloads the largest
page_id is a response and the others are revisits that refer to it. Archives are read back
as a stream; every RUN_ROWS captures are sorted by URL key and timestamp and written as a run
file in small blocks, with the first key of each block as a sparse index. Only that index
goes through Spark. Its keys part the captures into ranges of like size; a range opens its
blocks of all runs, one block of each at a time, and merges them with a loser tree, so a
task's memory follows the number of runs, not of captures. Beyond FAN_IN runs, groups are
merged to longer runs in the shared folder first. Capture histories come out in global order.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone
from itertools import islice
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import attempt_name, bounded, create, open_input
from .scratch import shared_dir, staged

EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
LEAST_REVISIT_BYTES = 0
GZIP_LEVEL = 6
#: Captures of a run, which a task sorts at a time, and of a block, of which a merge holds one a run.
RUN_ROWS, BLOCK_ROWS = 1 << 15, 256
#: Runs that are merged at a time.
FAN_IN = 256
#: Captures of a range, where there are more than the session's partitions need.
RANGE_ROWS = 1 << 20
CAPTURES = "page_id long, url_key string, captured string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, place long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Host labels in reverse, then path and query, lower case; empty for no URL."""
    if not url:
        return ""
    try:
        parts = urlsplit(url if "//" in url else f"//{url}")
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    tail = parts.path + (f"?{parts.query}" if parts.query else "")
    return (",".join(reversed(host.split("."))) + ")" + (tail or "/")).lower()


def captured(page_id: int | None) -> str:
    """The capture time of a page without one: seconds since EPOCH by id."""
    return (EPOCH + timedelta(seconds=(page_id or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, place: str = "") -> bytes:
    """One WARC 1.1 record; a revisit has no block and names the page it refers to.

    A record's id is its page's with ``place`` after it, as rows may repeat a page_id.
    """
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}{place}>",
        f"WARC-Date: {captured(page_id)}",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("the record's length does not match its block")
    return fields, rest[:n]


def read_members(source, step: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Place and content of each gzip member of a file, read ``step`` bytes at a time."""
    place, used, parts, unzip, raw = 0, 0, [], zlib.decompressobj(31), b""
    while True:
        if not raw:
            raw = source.read(step)
            if not raw:
                if parts or used:
                    raise ValueError("the archive ends inside a record")
                return
        parts.append(unzip.decompress(raw))
        used += len(raw) - len(unzip.unused_data)
        raw = unzip.unused_data
        if unzip.eof:
            yield place, b"".join(parts)
            place, used, parts, unzip = place + used, 0, [], zlib.decompressobj(31)


def loser_tree(runs: list[Iterator], key: Callable) -> Iterator:
    """Merges ascending iterators: each item costs one path of comparisons from leaf to root.

    Only the head of each run is held.
    """
    k = len(runs)
    if k == 0:
        return
    runs = [iter(r) for r in runs]
    items: list = [None] * k

    def head(i: int) -> tuple:
        for items[i] in runs[i]:
            return 0, key(items[i]), i
        return 1, (), i

    heads = [head(i) for i in range(k)]
    tree = [-1] * k  # inner nodes hold the losers; tree[0] the winner

    def play(leaf: int) -> None:
        winner, node = leaf, (leaf + k) // 2
        while node > 0:
            if tree[node] == -1:  # while the tree is built the first comer waits here
                tree[node] = winner
                return
            if heads[tree[node]] < heads[winner]:
                tree[node], winner = winner, tree[node]
            node //= 2
        tree[0] = winner

    for leaf in range(k):
        play(leaf)
    while heads[tree[0]][0] == 0:
        i = tree[0]
        yield items[i]
        heads[i] = head(i)
        play(i)


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Writes all pages below ``folder``; gives the archives: archive, records, bytes."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("html"))
    size = F.octet_length("html")
    marked = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    keys = marked.filter(size >= least_bytes).select("page_id", "digest")
    copies = keys.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1 and keeper is not null")
    copies = staged(copies.select("digest", "keeper"), "copies")
    joined = marked.join(copies.hint("merge"), "digest", "left").select("page_id", "url", "html", F.when((size >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, place, n = None, "", 0, 0
        for batch in bounded(batches, "html"):
            if out is None:
                name = f"{folder}/{attempt_name('pages', '.warc.gz')}"
                out = create(name)
            for page, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                body = html.encode()
                zipped = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
                raw = zipped.compress(record(page, url, body, payload_digest(body), refers, f"/{name.rpartition('/')[2]}/{place}")) + zipped.flush()
                out.write(raw)
                place, n = place + len(raw), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [name], "records": [n], "bytes": [place]})

    return staged(joined.mapInArrow(run, "archive string, records long, bytes long"), "archives")


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">").partition("/")[0]
    return int(number) if number else None


def order_of(row: tuple) -> tuple:
    """URL key, timestamp, then page (none first) and place."""
    return row[1], row[2], (row[0] is not None, row[0] or 0), row[7], row[8]


_NAMES = [x.split()[0] for x in CAPTURES.split(", ")]
_KINDS = [pa.int64() if "long" in x else pa.string() for x in CAPTURES.split(", ")]
_SCHEMA = pa.schema(list(zip(_NAMES, _KINDS, strict=True)))
#: A block's place and the first key in it, in the order of order_of.
BLOCKS = "run string, block long, rows long, url_key string, captured string, known boolean, page_id long, archive string, place long"
_KEY = ["url_key", "captured", "known", "page_id", "archive", "place"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], schema=_SCHEMA)


def _flat(key: tuple) -> tuple:
    url, at, (known, page), archive, place = key
    return url, at, known, page, archive, place


def read_captures(name: str) -> Iterator[tuple]:
    """The captures of an archive, in the order of its records."""
    with open_input(name) as source:
        for place, raw in read_members(source):
            fields, body = parse_record(raw)
            revisit = fields["warc-type"] == "revisit"
            digest = fields["warc-payload-digest"].removeprefix("sha1:") if revisit else payload_digest(body)
            size = int(fields["warc-payload-length"]) if revisit else len(body)
            refers = _page(fields["warc-refers-to"]) if revisit else None
            yield _page(fields["warc-record-id"]), url_key(fields["warc-target-uri"]), fields["warc-date"], size, digest, fields["warc-type"], refers, name, place


def write_run(rows: Iterator[tuple], folder: str, block_rows: int = BLOCK_ROWS) -> Iterator[tuple]:
    """Writes ascending captures as one run file; gives the rows of its sparse index."""
    name = f"{folder}/{attempt_name('run', '.arrow')}"
    with create(name) as out, pa.ipc.new_file(out, _SCHEMA) as file:
        for k, block in enumerate(iter(lambda: list(islice(rows, block_rows)), [])):
            file.write_batch(_batch(block))
            yield name, k, len(block), *_flat(order_of(block[0]))


def read_run(name: str, blocks: list[int]) -> Iterator[tuple]:
    """The captures of these blocks of a run; one block is held at a time."""
    with open_input(name) as source:
        file = pa.ipc.open_file(source)
        for k in blocks:
            yield from zip(*(c.to_pylist() for c in file.get_batch(k).columns), strict=True)


def sorted_runs(archives: DataFrame, folder: str, run_rows: int = RUN_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Reads the archives, writes their captures as sorted runs below ``folder``; gives BLOCKS."""
    names = [x.split()[0] for x in BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                found = read_captures(name)
                while rows := sorted(islice(found, run_rows), key=order_of):
                    index = list(write_run(iter(rows), folder, block_rows))
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*index, strict=True)), strict=True)))

    return archives.select("archive").repartition(max(1, archives.count())).mapInArrow(run, BLOCKS)


def merged(streams: list[Callable[[], Iterator]], folder: str, fan_in: int = FAN_IN) -> Iterator[tuple]:
    """One ascending stream of many; more than ``fan_in`` are merged by groups into spilled runs first."""
    while len(streams) > fan_in:
        longer = []
        for i in range(0, len(streams), fan_in):
            index = list(write_run(loser_tree([s() for s in streams[i : i + fan_in]], order_of), folder))
            if index:
                longer.append(lambda name=index[0][0], n=len(index): read_run(name, list(range(n))))
        streams = longer
    yield from loser_tree([s() for s in streams], order_of)


def _cuts(blocks: DataFrame, ranges: int) -> list[tuple]:
    """Keys that part the captures into about ``ranges`` ranges of like size."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                least = row if least is None or row < least else least
        if least is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(least, batch.schema.types, strict=True)], names=_KEY)

    keys = blocks.select(*_KEY)
    found = keys.repartitionByRange(ranges, *_KEY).mapInArrow(first, keys.schema).collect()
    return sorted(tuple(r) for r in found)[1:]


def merge_captures(blocks: DataFrame, folder: str, *, range_rows: int = RANGE_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """All captures of the runs in global order: ``merged`` ascends with URL key and timestamp.

    A range holds about as many captures as any other (page_id and place break ties, so a URL
    captured very often is split too). The keys between ranges are the only rows that reach
    the driver: one for each of the session's partitions or for ``range_rows`` captures.
    """
    spark = blocks.sparkSession
    total, count = blocks.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count(F.lit(1))).first()
    ranges = max(1, min(count, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // range_rows)))
    cuts = spark.sparkContext.broadcast(_cuts(blocks, ranges))
    ends = blocks.withColumn("next", F.lead(F.struct(*_KEY)).over(Window.partitionBy("run").orderBy("block")))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple = ([], [], [])
            for name, block, key, after in zip(*(batch.column(c).to_pylist() for c in ("run", "block", "key", "next")), strict=True):
                first = bisect.bisect_right(cuts.value, tuple(key[c] for c in _KEY))
                last = len(cuts.value) if after is None else bisect.bisect_right(cuts.value, tuple(after[c] for c in _KEY))
                for k in range(first, last + 1):
                    for x, v in zip(out, (k, name, block), strict=True):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.string(), pa.int64()), strict=True)], names=["range", "run", "block"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, own = None, {}

        def done() -> Iterator[pa.RecordBatch]:
            low = cuts.value[here - 1] if here else None
            high = cuts.value[here] if here < len(cuts.value) else None

            def part(name: str, numbers: list[int]) -> Iterator[tuple]:
                for row in read_run(name, numbers):
                    key = _flat(order_of(row))
                    if high is not None and key >= high:
                        return
                    if low is None or key >= low:
                        yield row

            rows = merged([lambda name=name, numbers=numbers: part(name, numbers) for name, numbers in own.items()], folder, fan_in)
            first = here << 40
            for some in iter(lambda: list(islice(rows, 4096)), []):
                yield pa.RecordBatch.from_arrays([*_batch(some).columns, pa.array(range(first, first + len(some)), pa.int64())], names=[*_NAMES, "merged"])
                first += len(some)

        for batch in batches:
            for k, name, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != here:
                    if here is not None:
                        yield from done()
                    here, own = k, {}
                own.setdefault(name, []).append(block)
        if here is not None:
            yield from done()

    spreads = ends.select("run", "block", F.struct(*_KEY).alias("key"), "next").mapInArrow(spread, "range int, run string, block long")
    dealt = spreads.repartition(ranges, "range").sortWithinPartitions("range", "run", "block")
    return dealt.mapInArrow(merge, f"{CAPTURES}, merged long")


def archive_round_trip(pages: DataFrame, *, run_rows: int = RUN_ROWS, range_rows: int = RANGE_ROWS, fan_in: int = FAN_IN, **options) -> DataFrame:
    """Writes WARC archives to the shared folder, reads them back and merges their index.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to, then
    url_key, captured, archive, place, merged. Defined cases: a null html is an empty
    payload; a null url has the empty key; a null page_id is never referred to; rows that
    repeat a page_id and payload are all responses if that page_id is the largest; an empty
    table gives no archive and no rows; other columns of ``pages`` are not read.
    """
    folder = shared_dir(pages.sparkSession, "warc")
    archives = write_archives(pages, folder, **options)
    blocks = staged(sorted_runs(archives, f"{folder}-runs", run_rows), "blocks")
    found = merge_captures(blocks, f"{folder}-runs", range_rows=range_rows, fan_in=fan_in)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "archive", "place", "merged")
