"""Removal of lines that many documents share.

Two Bloom filters hold hashes of lines seen in one document and in a second one. A pass
without a shuffle of text writes the distinct line hashes of each part of the corpus; their
count sizes the filters, BITS_PER_LINE for each, so that they are as sharp at any size. The
filters are split by ranges of the hash, and a range is filled from all parts' hashes in it
by once |= new; twice |= new that was in once, which loses no line that two parts share.
A line outside the second filter is in one document and stays; the others, suspected
repeats, shuffle as (document, 128-bit digest), are counted exactly, and the largest doc_id
of each is chosen. While all ranges together are small they are broadcast; beyond MOST_BITS
they stay where they are and digests of lines travel to them instead, at most one of each
line from each part of the corpus, so that a line in a third of all documents is no hot key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import bounded
from .idfilter import bit_at, id_filter, passing
from .scratch import free_name, staged

BLANKS = " \t\n\x0b\x0c\r"
LEAST_CHARS = 40
LEAST_DOCS = 5
BITS_PER_LINE = 12
#: log2 of the bits of the filter that is broadcast at most: 32 MB.
MOST_BITS = 28
HASHES = 3
#: Hashes that one row of a part holds at most, and lines that a range is meant for.
PART_LINES = 1 << 19
RANGE_LINES = 1 << 17
LEAST_RANGES, MOST_RANGES = 6, 24


def line_key(line: str, least_chars: int = LEAST_CHARS) -> bytes | None:
    """What makes lines equal, in UTF-8; None for lines that are too short to count."""
    key = line.strip(BLANKS)
    return key.encode("utf-8", "surrogatepass").lower() if len(key) >= least_chars else None


def line_keys(text: str | None, least_chars: int = LEAST_CHARS) -> set[bytes]:
    """The distinct keys of a text's lines."""
    keys = {line_key(x, least_chars) for x in (text or "").split("\n")}
    keys.discard(None)
    return keys


@dataclass(frozen=True)
class Size:
    """2**ranges tables of 2**inner bits each."""

    ranges: int
    inner: int

    @classmethod
    def of(cls, lines: int) -> "Size":
        """For so many distinct lines."""
        ranges = min(MOST_RANGES, max(LEAST_RANGES, int(np.ceil(np.log2(max(1, lines) / RANGE_LINES)))))
        return cls(ranges, max(9, int(np.ceil(np.log2(max(1, lines) * BITS_PER_LINE))) - ranges))

    @property
    def bits(self) -> int:
        return self.ranges + self.inner

    def range_of(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.ranges)).astype(np.int64)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """HASHES places for each hash in its range's table."""
        first, step = hashes & np.uint64(0xFFFFFFFF), ((hashes >> np.uint64(8)) & np.uint64(0xFFFFFFFF)) | np.uint64(1)
        mask = np.uint64((1 << self.inner) - 1)
        return np.stack([(first + np.uint64(i) * step) & mask for i in range(HASHES)], axis=1).astype(np.int64)


class Seen:
    """The pair of filters of one range."""

    def __init__(self, size: Size):
        self.size = size
        self.once, self.twice = np.zeros(1 << size.inner, bool), np.zeros(1 << size.inner, bool)

    def add(self, hashes: np.ndarray, repeated: np.ndarray) -> None:
        """Distinct line hashes of one part, and those of them that several of its documents hold."""
        at = self.size.places(hashes)
        again = self.once[at].all(axis=1)
        self.twice[at[again]] = True
        self.twice[self.size.places(repeated)] = True
        self.once[at] = True


PARTS = "n long, once binary, twice binary"
RANGES = "range int, once binary, twice binary"


def line_hashes(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Parts of the corpus as (n, once, twice): distinct line hashes, and the repeated ones."""

    def part(hashes: list[np.ndarray]) -> pa.RecordBatch:
        found, counts = np.unique(np.concatenate(hashes), return_counts=True)
        return pa.RecordBatch.from_pydict({"n": [len(found)], "once": [found.astype("<u8").tobytes()], "twice": [found[counts > 1].astype("<u8").tobytes()]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, n = [], 0
        for batch in bounded(batches):
            found = [xxhash.xxh3_64_intdigest(k) for text in batch.column("text").to_pylist() for k in line_keys(text, least_chars)]
            for i in range(0, len(found), PART_LINES):
                hashes.append(np.array(found[i : i + PART_LINES], np.uint64))
                n += len(hashes[-1])
                if n >= PART_LINES:
                    yield part(hashes)
                    hashes, n = [], 0
        if n:
            yield part(hashes)

    return docs.select("text").mapInArrow(run, PARTS)


def twice_seen(parts: DataFrame, size: Size) -> DataFrame:
    """(range, bits): each range's twice-seen filter, packed, from all parts' hashes in it."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for once, twice in zip(batch.column("once").to_pylist(), batch.column("twice").to_pylist(), strict=True):
                lists = [np.frombuffer(x, "<u8") for x in (once, twice)]
                ranges, begins = np.unique(size.range_of(lists[0]), return_index=True)
                firsts = np.append(begins, len(lists[0]))
                low = np.searchsorted(size.range_of(lists[1]), np.append(ranges, 1 << size.ranges))
                rows = [[x[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)] for x, at in zip(lists, (firsts, low), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.binary())], names=["range", "once", "twice"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, seen = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([here], pa.int32()), pa.array([np.packbits(seen.twice).tobytes()], pa.binary())], names=["range", "bits"])

        for batch in batches:
            for k, once, twice in zip(*(batch.column(c).to_pylist() for c in ("range", "once", "twice")), strict=True):
                if k != here:
                    if here is not None:
                        yield done()
                    here, seen = k, Seen(size)
                seen.add(np.frombuffer(once, "<u8"), np.frombuffer(twice, "<u8"))
        if here is not None:
            yield done()

    return parts.mapInArrow(split, RANGES).repartition("range").sortWithinPartitions("range").mapInArrow(fill, "range int, bits binary")


FOUND = "doc_id long, digest binary"


def _digests(batch: pa.RecordBatch, least_chars: int) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Row, digest and hash of the distinct lines of each document."""
    rows, keys = [], []
    for i, (text, known) in enumerate(zip(batch.column("text").to_pylist(), batch.column("doc_id").is_valid().to_pylist(), strict=True)):
        own = line_keys(text, least_chars) if known else ()
        keys += own
        rows += [i] * len(own)
    return np.array(rows, np.int64), keys, np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)


def _found(batch: pa.RecordBatch, rows: np.ndarray, keys: list[bytes], hit: np.ndarray) -> list[pa.Array]:
    return [batch.column("doc_id").take(pa.array(rows[hit])), pa.array([xxhash.xxh3_128_digest(keys[i]) for i in hit.tolist()], pa.binary())]


def suspects_here(docs: DataFrame, packed, size: Size, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, digest) of lines that pass the broadcast twice-seen filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = packed.value
        for batch in bounded(batches):
            rows, keys, hashes = _digests(batch, least_chars)
            at = (size.range_of(hashes) << size.inner)[:, None] + size.places(hashes)
            hit = np.flatnonzero(bit_at(table, at).all(axis=1)) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(_found(batch, rows, keys, hit), names=["doc_id", "digest"])

    return docs.select("doc_id", "text").mapInArrow(run, FOUND)


def suspects_there(docs: DataFrame, filters: DataFrame, size: Size, least_chars: int = LEAST_CHARS) -> DataFrame:
    """The same where the filter is too large to send: digests go to their range's filter.

    A line that a part has already met is a suspect there and then; only its first document
    in the part has to ask.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(1 << 24, bool)
        for batch in bounded(batches):
            rows, keys, hashes = _digests(batch, least_chars)
            at = (hashes & np.uint64((1 << 24) - 1)).astype(np.int64)
            again = met[at]
            first = np.zeros(len(at), bool)
            first[np.unique(at, return_index=True)[1]] = True
            met[at] = True
            where = np.where(again | ~first, -1, size.range_of(hashes)) if keys else np.zeros(0, np.int64)
            every = np.arange(len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(hashes.view(np.int64)), *_found(batch, rows, keys, every)], names=["range", "hash", "doc_id", "digest"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, table = None, None
        for batch in batches:
            ranges = batch.column("range").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(ranges)) + 1, [len(ranges)]]).tolist()
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                part = batch.slice(i, j - i)
                if ranges[i] != here:
                    here, table = ranges[i], np.frombuffer(part.column("bits")[0].as_py(), np.uint8)
                asked = part.filter(pc.is_null(part.column("bits")))
                hit = bit_at(table, size.places(asked.column("hash").to_numpy().view(np.uint64))).all(axis=1)
                yield asked.select(["doc_id", "digest"]).filter(pa.array(hit, pa.bool_()))

    asked = staged(docs.select("doc_id", "text").mapInArrow(ask, f"range int, hash long, {FOUND}"), "asked")
    none = filters.select("range", F.lit(None).cast("long").alias("hash"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("digest"), "bits")
    meet = asked.filter("range >= 0").withColumn("bits", F.lit(None).cast("binary")).unionByName(none)
    meet = meet.repartition("range").sortWithinPartitions("range", F.col("bits").isNull())
    return asked.filter("range < 0").select("doc_id", "digest").unionByName(meet.mapInArrow(answer, FOUND))


def suspects(docs: DataFrame, least_chars: int = LEAST_CHARS, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, digest) of lines (doc_id, text) that may be in two documents or more."""
    spark = docs.sparkSession
    parts = staged(line_hashes(docs, least_chars), "line-hashes")
    size = Size.of(parts.agg(F.sum("n")).first()[0] or 0)
    filters = twice_seen(parts, size)
    if size.bits > most_bits:
        return suspects_there(docs, staged(filters, "line-filters"), size, least_chars)
    whole, each = np.zeros((1 << size.bits) // 8, np.uint8), (1 << size.inner) // 8
    for k, raw in filters.collect():
        whole[k * each : (k + 1) * each] = np.frombuffer(raw, np.uint8)
    return suspects_here(docs, spark.sparkContext.broadcast(whole), size, least_chars)


def drop_lines(text: str, digests: set[bytes], least_chars: int = LEAST_CHARS) -> tuple[str, int]:
    """The text without lines of these digests, and how many went."""
    lines = text.split("\n")
    kept = [x for x in lines if (k := line_key(x, least_chars)) is None or xxhash.xxh3_128_digest(k) not in digests]
    return "\n".join(kept), len(lines) - len(kept)


def line_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_chars: int = LEAST_CHARS,
    least_docs: int = LEAST_DOCS,
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """All columns of ``docs``, the text without repeated lines, and n_lines, n_dropped.

    A line's key is the line without blanks at both ends, A-Z lowered. Keys of at least
    ``least_chars`` code points that at least ``least_docs`` documents hold lose all their
    lines except in the largest doc_id among these. Defined cases: a null or empty text is
    one empty line and becomes empty; a document all of whose lines go becomes empty; rows
    that repeat a doc_id count as one document, and each is cleaned; rows with a null doc_id
    keep their lines and count as no document; an empty table gives no rows; other columns
    pass through, and n_lines or n_dropped replace columns of these names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = staged(suspects(rows, least_chars, most_bits).distinct(), "suspects")
    repeated = found.groupBy("digest").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keep")).filter(F.col("docs") >= least_docs)
    repeated = staged(repeated.select("digest", "keep"), "repeated")
    text_c, id_c, drop_id, drops_c = (free_name(docs, x) for x in ("line_text", "line_id", "line_drop_id", "line_drops"))
    drops = found.join(repeated, "digest").filter("doc_id <> keep").groupBy(F.col("doc_id").alias(drop_id)).agg(F.collect_list("digest").alias(drops_c))
    drops = staged(drops, "drops")
    passing_on = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    whole = docs.select(*[F.col(f"`{c}`") for c in passing_on], F.col(text_col).alias(text_c), F.col(id_col).cast("long").alias(id_c))
    # only documents that lose a line (and a few that the filter cannot tell from them) move
    losing = spark.sparkContext.broadcast(id_filter(drops.select(drop_id)))
    joined = passing(whole, id_c, losing).join(drops.hint("merge"), F.col(id_c) == F.col(drop_id), "left").drop(id_c, drop_id)
    kept_fields = [joined.schema[c] for c in passing_on]

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, text_c):
            texts, lines, gone = [], [], []
            for text, digests in zip(batch.column(text_c).to_pylist(), batch.column(drops_c).to_pylist(), strict=True):
                text = text or ""
                kept, n = drop_lines(text, set(digests), least_chars) if digests else (text, 0)
                texts.append(kept)
                lines.append(text.count("\n") + 1)
                gone.append(n)
            arrays = [batch.column(c) for c in passing_on] + [pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*passing_on, text_c, "n_lines", "n_dropped"])

    schema = T.StructType([*kept_fields, T.StructField(text_c, T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    text = F.coalesce(text_c, F.lit(""))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    still = passing(whole, id_c, losing, passes=False).select(*[F.col(f"`{c}`") for c in passing_on], text.alias(text_c), lines.cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    cleaned = joined.mapInArrow(clean, schema).unionByName(still)
    order = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return cleaned.select(*[F.col(text_c).alias(c) if c == text_col else F.col(f"`{c}`") for c in order], "n_lines", "n_dropped")
