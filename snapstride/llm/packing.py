"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. A piece goes to the window it fits
most tightly; where none fits, the fullest window is topped up with the front of the piece
(if that is at least ``least_cut`` tokens) and emitted. Windows still open at the end of a
partition are taken apart, and their pieces are packed again for groups of partitions.
Memory is the open windows; only leftovers, at most ``open_windows`` a partition, move.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import bounded, partition_id
from .scratch import staged
from .tokens import encoder

WINDOW = 4096
OPEN_WINDOWS = 64
LEAST_CUT = 64
MERGED_PARTITIONS = 32
END_ID = 2
MERGED = 1 << 62

#: doc_id, start, length, crc, doc_tokens: a piece; then its window and place there
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
_SCHEMA = pa.schema([(n, pa.int64()) for n in _NAMES])


class Packer:
    """Packs (length, item) pairs; ``place`` and ``rest`` give finished windows.

    ``cut(item, k)`` splits an item after k tokens; without it items stay whole.
    """

    def __init__(self, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, least_cut: int = LEAST_CUT, cut=None):
        self.window, self.most, self.least_cut, self.cut = window, open_windows, least_cut, cut
        self.free: list[tuple[int, int]] = []  # (free tokens, slot), ascending
        self.slots: dict[int, list] = {}
        self.next = 0

    def _put(self, left: int, slot: int, length: int, item) -> list | None:
        self.slots[slot].append((length, item))
        if left == length:
            return self.slots.pop(slot)
        insort(self.free, (left - length, slot))
        return None

    def place(self, length: int, item) -> Iterator[list]:
        """Adds an item of at most a window; yields the windows this finishes."""
        at = bisect_left(self.free, (length, -1))
        if at < len(self.free):
            done = self._put(*self.free.pop(at), length, item)
            if done:
                yield done
            return
        if len(self.free) >= self.most:
            left, slot = self.free.pop(0)  # the fullest
            if self.cut and left >= self.least_cut and length - left >= self.least_cut:
                head, item = self.cut(item, left)
                self.slots[slot].append((left, head))
                length -= left
            yield self.slots.pop(slot)
            yield from self.place(length, item)
            return
        self.slots[self.next] = []
        done = self._put(self.window, self.next, length, item)
        self.next += 1
        if done:
            yield done

    def rest(self) -> Iterator[list]:
        """The windows that are still open, in the order they were opened."""
        for slot in sorted(self.slots):
            yield self.slots[slot]
        self.free, self.slots = [], {}


def _cut(item, k: int):
    doc, start, ids, total = item
    return (doc, start, ids[:k], total), (doc, start + k, ids[k:], total)


def _rows(windows: Iterable[list], first_id: int) -> Iterator[tuple]:
    for n, window in enumerate(windows):
        at = 0
        for length, (doc, start, ids, total) in window:
            yield doc, start, length, zlib.crc32(ids), total, first_id + n, at
            at += length


def pack_texts(path: str, window: int, open_windows: int, least_cut: int):
    """A mapInArrow function: doc_id, text -> pieces, with ``left`` set for leftovers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, spaced=False)
        packer = Packer(window, open_windows, least_cut, _cut)
        base = partition_id() << 32

        def windows(batch: pa.RecordBatch) -> Iterator[list]:
            coded = coder.texts(batch.column("text"), END_ID)
            ids = coded.ids.astype("<u4")
            for doc, s, e in zip(batch.column("doc_id").to_pylist(), coded.offs[:-1].tolist(), coded.offs[1:].tolist(), strict=True):
                whole = (e - s) // window * window
                for at in range(0, whole, window):
                    yield [(window, (doc, at, ids[s + at : s + at + window], e - s))]
                if whole < e - s:
                    yield from packer.place(e - s - whole, (doc, whole, ids[s + whole : e].copy(), e - s))

        def batch_of(rows: list[tuple], left: bool) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
            arrays = [pa.array(c, pa.int64()) for c in columns]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([left] * len(rows))], schema=_SCHEMA.append(pa.field("left", pa.bool_())))

        n = 0
        for batch in bounded(batches):
            rows = []
            for done in windows(batch):
                rows += _rows([done], base + n)
                n += 1
            yield batch_of(rows, False)
        yield batch_of(list(_rows(packer.rest(), base + n)), True)

    return run


def _merge(window: int):
    """An applyInPandas function: best fit, longest piece first, for one group of leftovers."""

    def run(key: tuple, left: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["length", "sequence_id", "offset"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        packer = Packer(window, open_windows=1 << 60)
        done = []
        for i, length in enumerate(left["length"].tolist()):
            done += packer.place(length, i)
        done += packer.rest()
        seq, off = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        for n, pieces in enumerate(done):
            at = 0
            for length, i in pieces:
                seq[i], off[i] = MERGED + (int(key[0]) << 32) + n, at
                at += length
        return left.assign(sequence_id=seq, offset=off)[_NAMES]

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    least_cut: int = LEAST_CUT,
    merged_partitions: int = MERGED_PARTITIONS,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of ``tokenizer`` and the end id. ``start`` is a place in the
    document, ``offset`` one in the sequence; both are gapless. ``tokenizer`` must be readable
    at that path on every executor. Defined cases: a null or empty text is the end id alone;
    rows that repeat a doc_id are packed as documents of their own; a null doc_id stays
    null; a document longer than a window gives full windows and one rest; an empty table
    gives no rows; other columns of ``docs`` are not read.
    """
    schema = ", ".join(f"{n} long" for n in _NAMES)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(pack_texts(tokenizer, window, open_windows, least_cut), f"{schema}, left boolean")
    rows = staged(rows, "packed")
    group = F.floor(F.shiftright("sequence_id", 32) / merged_partitions).cast("long")
    merged = rows.filter("left").select(*_NAMES).groupBy(group.alias("part")).applyInPandas(_merge(window), schema)
    return rows.filter("not left").select(*_NAMES).unionByName(merged)
