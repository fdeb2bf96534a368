"""Token ids in files of byte planes, and back.

A file holds the documents of one range of ids, in ascending order. Its ids are cut into
blocks of a fixed number; a block is transposed into four planes (all lowest bytes, all
second bytes, ...) and each plane is compressed with zstandard by itself, so the almost
constant high bytes cost nothing. The chunk index at the end gives, for each block, its
place, its ids and its planes' sizes; a reader fetches any block with one seek.

Layout, little-endian: ``SSPLANE1``; blocks; the documents' table (ids, null flags and
token counts, compressed); the index (int64 rows: place, ids, four sizes); a tail of
int64: place and size of the documents' table, its rows, blocks, ids in all; ``SSPLANE1``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import attempt_name, bounded, create, open_input, partition_id
from .scratch import shared_dir, staged
from .tokens import encoder

MAGIC = b"SSPLANE1"
BLOCK = 1 << 16
LEVEL = 3
END_ID = 2
PLANES = 4
MANIFEST = "part long, file string, docs long, tokens long, bytes long"


class PlaneWriter:
    def __init__(self, out, block: int = BLOCK, level: int = LEVEL):
        self.out, self.block = out, block
        self.pack = zstandard.ZstdCompressor(level=level)
        self.index: list[list[int]] = []
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.open: list[np.ndarray] = []
        self.waiting = self.tokens = 0
        self.at = len(MAGIC)
        out.write(MAGIC)

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Documents in order, with the ids of all of them in ``ids``."""
        self.docs.append((doc_ids.astype("<i8"), nulls.astype("u1"), counts.astype("<i8")))
        self.open.append(ids.astype("<u4"))
        self.waiting += len(ids)
        self.tokens += len(ids)
        if self.waiting >= self.block:
            ids = np.concatenate(self.open)
            whole = len(ids) // self.block * self.block
            for i in range(0, whole, self.block):
                self._write_block(ids[i : i + self.block])
            self.open, self.waiting = [ids[whole:].copy()], len(ids) - whole

    def _write_block(self, ids: np.ndarray) -> None:
        planes = np.ascontiguousarray(ids.view("u1").reshape(-1, PLANES).T)
        packed = [self.pack.compress(p.tobytes()) for p in planes]
        self.index.append([self.at, len(ids), *map(len, packed)])
        for p in packed:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> int:
        """Ends the file; gives its size."""
        if self.waiting:
            self._write_block(np.concatenate(self.open))
        columns = [np.concatenate([d[i] for d in self.docs]) if self.docs else np.zeros(0) for i in range(3)]
        table = self.pack.compress(columns[0].astype("<i8").tobytes() + columns[1].astype("u1").tobytes() + columns[2].astype("<i8").tobytes())
        index = np.array(self.index, "<i8").tobytes()
        tail = np.array([self.at, len(table), len(columns[0]), len(self.index), self.tokens], "<i8").tobytes()
        for x in (table, index, tail, MAGIC):
            self.out.write(x)
        self.out.close()
        return self.at + len(table) + len(index) + len(tail) + len(MAGIC)


class PlaneReader:
    def __init__(self, source):
        self.source = source
        size = source.size()
        end = 5 * 8 + len(MAGIC)
        tail = self._at(size - end, end)
        if tail[-len(MAGIC) :] != MAGIC or self._at(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a file of id planes")
        place, length, n, blocks, self.tokens = np.frombuffer(tail[: -len(MAGIC)], "<i8").tolist()
        unpack = zstandard.ZstdDecompressor()
        table = unpack.decompress(self._at(place, length), max_output_size=max(1, n * 17))
        self.doc_ids = np.frombuffer(table[: 8 * n], "<i8")
        self.nulls = np.frombuffer(table[8 * n : 9 * n], "u1").astype(bool)
        self.counts = np.frombuffer(table[9 * n :], "<i8")
        self.index = np.frombuffer(self._at(place + length, blocks * 8 * (2 + PLANES)), "<i8").reshape(-1, 2 + PLANES)

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def block(self, i: int) -> np.ndarray:
        place, n, *sizes = self.index[i].tolist()
        raw, unpack, planes, at = self._at(place, sum(sizes)), zstandard.ZstdDecompressor(), [], 0
        for s in sizes:
            planes.append(np.frombuffer(unpack.decompress(raw[at : at + s], max_output_size=n), "u1"))
            at += s
        return np.ascontiguousarray(np.stack(planes, axis=1)).view("<u4").ravel()

    def crcs(self) -> np.ndarray:
        """crc32 of each document's ids, block by block."""
        out = np.zeros(len(self.counts), np.int64)
        block, data, at = -1, b"", 0
        for d, n in enumerate(self.counts.tolist()):
            crc, need = 0, 4 * n
            while need:
                if at == len(data):
                    block += 1
                    data, at = self.block(block).tobytes(), 0
                take = min(need, len(data) - at)
                crc = zlib.crc32(data[at : at + take], crc)
                at, need = at + take, need - take
            out[d] = crc
        return out


def write_ids(
    docs: DataFrame, tokenizer: str, folder: str, *, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, level: int = LEVEL
) -> DataFrame:
    """Writes the ids of all documents below ``folder``; gives the files: part, file, docs, tokens, bytes.

    Texts move once, to ranges of ids; the order of files by ``part`` and of documents in
    them is ascending doc_id. Each attempt of a task writes a file of its own and only the
    manifest says which count. Defined cases: a null text counts as empty, which is the end
    id alone; a null doc_id comes first; rows that repeat a doc_id come in the order of their
    texts; an empty table gives an empty manifest; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, name = None, ""
        coder = encoder(tokenizer, spaced=True)
        for batch in bounded(batches):
            if writer is None:
                name = f"{folder}/{attempt_name('ids', '.planes')}"
                writer = PlaneWriter(create(name), block, level)
            coded = coder.texts(batch.column("text"), END_ID)
            key = batch.column("doc_id")
            writer.add(key.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(key.is_null()), np.diff(coded.offs), coded.ids)
        if writer is not None:
            n = sum(len(d[0]) for d in writer.docs)
            size = writer.close()
            yield pa.RecordBatch.from_pydict({"part": [partition_id()], "file": [name], "docs": [n], "tokens": [writer.tokens], "bytes": [size]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return staged(rows.mapInArrow(run, MANIFEST), "manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it; only the manifest, a row for each
    file, is summed in one place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with open_input(name) as source:
                    reader = PlaneReader(source)
                    counts = reader.counts
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(reader.doc_ids, mask=reader.nulls), pa.array(base + np.cumsum(counts) - counts), pa.array(counts), pa.array(reader.crcs())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    files = manifest.withColumn("base", F.sum("tokens").over(before) - F.col("tokens")).select("file", "base")
    files = files.repartition(max(1, manifest.count()))
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def ids_round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes all documents' ids to the shared folder and reads the files back."""
    return read_ids(write_ids(docs, tokenizer, shared_dir(docs.sparkSession, "ids"), **options))
