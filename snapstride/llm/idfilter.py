"""A Bloom filter of row ids, sized by their count, to leave rows behind before a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .scratch import free_name
from .words import mix

BITS_PER_ID = 16
#: The most that is broadcast: 64 MB. Beyond 40 million ids the filter lets more rows through.
MOST_BITS = 29
BLOCK_BITS = 16


def bits_for(ids: int) -> int:
    """log2 of the filter's size: BITS_PER_ID or more for each id, up to MOST_BITS."""
    return min(MOST_BITS, max(BLOCK_BITS, int(np.ceil(np.log2(max(1, ids) * BITS_PER_ID)))))


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    h = mix(ids.astype(np.int64).view(np.uint64))
    mask = np.uint64((1 << bits) - 1)
    return np.stack([h & mask, (h >> np.uint64(32)) & mask], axis=1).astype(np.int64)


def bit_at(packed: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Bits of a table packed by np.packbits, without unpacking it."""
    return (packed[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1 != 0


def may_hold(packed: np.ndarray, key: pa.Array) -> np.ndarray:
    """Which ids may be in the filter; null ids are not."""
    bits = (8 * len(packed)).bit_length() - 1
    ids = key.fill_null(0).to_numpy(zero_copy_only=False)
    return bit_at(packed, _places(ids, bits)).all(axis=1) & np.asarray(key.is_valid())


def id_filter(ids: DataFrame, bits: int | None = None) -> np.ndarray:
    """The filter of a one-column table of longs, packed: 2**bits / 8 bytes.

    ``bits`` follows from a count of ``ids`` where it is not given. Each partition sends the
    places it sets, by block; blocks meet in streams that hold one bit table at a time, and
    only finished blocks reach the driver.
    """
    bits = bits_for(ids.count()) if bits is None else bits

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.unique(_places(batch.column(0).drop_null().to_numpy(zero_copy_only=False), bits))
            blocks = found >> BLOCK_BITS
            cuts = np.flatnonzero(np.diff(blocks)) + 1
            parts = np.split(found & ((1 << BLOCK_BITS) - 1), cuts) if len(found) else []
            keys = blocks[np.append(0, cuts)] if len(found) else []
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([p.astype("<u2").tobytes() for p in parts], pa.binary())], names=["block", "places"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, table = None, np.zeros(1 << BLOCK_BITS, bool)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(table).tobytes()], pa.binary())], names=["block", "places"])

        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != block:
                    if block is not None:
                        yield done()
                    block, table = k, np.zeros(1 << BLOCK_BITS, bool)
                table[np.frombuffer(raw, "<u2")] = True
        if block is not None:
            yield done()

    schema = "block int, places binary"
    whole, size = np.zeros((1 << bits) // 8, np.uint8), (1 << BLOCK_BITS) // 8
    for k, raw in ids.mapInArrow(fill, schema).repartition("block").sortWithinPartitions("block").mapInArrow(add, schema).collect():
        whole[k * size : (k + 1) * size] = np.frombuffer(raw, np.uint8)
    return whole


def passing(rows: DataFrame, id_col: str, packed, passes: bool = True) -> DataFrame:
    """Rows whose id may be in the broadcast filter: all that are, and a few that are not.

    With ``passes`` false the other rows, null ids among them.
    """
    at = rows.columns.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(packed.value, batch.column(at)) == passes))

    return rows.mapInArrow(run, rows.schema)


def without(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """``rows`` whose id is not in ``ids``, a one-column table; null ids stay.

    Rows that the filter of ``ids`` rules out pass where they are; only the others, those to
    go and a few the filter cannot tell from them, are shuffled and compared exactly.
    """
    spark = rows.sparkSession
    name = ids.columns[0]
    key = free_name(rows, "filter_key")
    gone = free_name(rows, "filter_gone")
    as_long = rows.withColumn(key, rows[id_col].cast("long"))
    packed = spark.sparkContext.broadcast(id_filter(ids.select(ids[name].cast("long"))))
    exact = ids.select(ids[name].cast("long").alias(gone))
    doubtful = passing(as_long, key, packed)
    doubtful = doubtful.join(exact.hint("merge"), doubtful[key] == exact[gone], "left_anti")
    return passing(as_long, key, packed, passes=False).unionByName(doubtful).drop(key)
