"""Language identification by bit-sliced Bloom filters of byte n-grams.

Place p of a table holds a bitmask of languages: bit l says that language l's filter has
bit p set; beyond 64 languages a mask has several words. One look-up of an n-gram, the
bitwise and of the masks at its places, gives all languages whose filters contain it. A
text's languages are judged by the popcount per language over its n-grams, corrected for
the share that a filter answers by chance.

An n-gram belongs to a language if it is at least ``share`` times as frequent there as in
the language where it is most frequent. Frequencies are counted over all learning documents
in tables of fixed size, and masks are made where a range of places comes together, so only
masks and one number a language reach the driver and are broadcast.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import bounded
from .words import LOWER, doc_sums, text_bytes

NGRAM = 4
TABLE_BITS = 18
SHARE = 0.5
LEAST_COUNT = 3
WORD = 64
#: Count tables that a task holds before it passes them on.
MOST_TABLES = 24
FOLDS = 5
UNKNOWN = "und"
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_LETTER = re.compile(r"[^\W\d_]")


def held_out(doc_id, folds: int = FOLDS):
    """Column: crc32 of the id as text is divisible by ``folds``."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def ngram_places(column: pa.Array, bits: int, n: int = NGRAM) -> tuple[list[np.ndarray], np.ndarray]:
    """Two table places for each n-gram of bytes of a document, and offsets by document.

    A-Z count as a-z; n-grams do not reach over documents; shorter texts have none.
    """
    data, offs = text_bytes(column)
    data = LOWER[data].astype(np.uint64)
    sizes = np.diff(offs)
    have = np.maximum(sizes - n + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(have)])
    if bounds[-1] == 0:
        return [np.zeros(0, np.int64)] * len(_MULTIPLIERS), bounds
    code = np.zeros(len(data) - n + 1, np.uint64)
    for k in range(n):
        code |= data[k : len(data) - n + 1 + k] << np.uint64(8 * k)
    if len(code) != bounds[-1]:
        code = code[np.arange(bounds[-1]) + np.repeat(offs[:-1] - bounds[:-1], have)]
    return [((code * np.uint64(m)) >> np.uint64(64 - bits)).astype(np.int64) for m in _MULTIPLIERS], bounds


def ngram_masks(docs: DataFrame, totals: dict[str, int], share: float = SHARE, bits: int = TABLE_BITS, n: int = NGRAM, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray]:
    """Masks by (look-up, word, place) and filled places by (look-up, language).

    docs: lang, text; totals: the n-grams of each language. All documents count.
    """
    looks, words = len(_MULTIPLIERS), -(-len(totals) // WORD)
    size, block = 1 << bits, min(1 << 12, 1 << bits)
    index = {x: i for i, x in enumerate(totals)}
    sums = np.maximum(np.array(list(totals.values()), float), 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}

        def rows() -> pa.RecordBatch:
            keys, out = [], []
            for lang, table in tables.items():
                for k in np.flatnonzero(table.reshape(-1, block).any(axis=1)).tolist():
                    keys.append((k, lang))
                    out.append(table.reshape(-1, block)[k].astype("<i8").tobytes())
            tables.clear()
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array([x for _, x in keys], pa.int32()), pa.array(out, pa.binary())], names=["block", "language", "counts"])

        for batch in bounded(batches):
            lang = np.array([index.get(x, -1) for x in batch.column("lang").to_pylist()])
            for i in np.unique(lang[lang >= 0]).tolist():
                places, _ = ngram_places(batch.column("text").filter(pa.array(lang == i)), bits, n)
                table = tables.setdefault(i, np.zeros((looks, size), np.int64))
                for k, at in enumerate(places):
                    table[k] += np.bincount(at, minlength=size)
            if len(tables) > MOST_TABLES:
                yield rows()
        yield rows()

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, counts = None, np.zeros((len(totals), block), np.int64)

        def done() -> pa.RecordBatch:
            rate = counts / sums[:, None]
            member = (rate >= share * rate.max(axis=0)) & (counts >= least)
            masks = np.zeros((words, block), np.uint64)
            for i in range(len(totals)):
                masks[i // WORD] |= member[i].astype(np.uint64) << np.uint64(i % WORD)
            return pa.RecordBatch.from_arrays([pa.array([here], pa.int32()), pa.array([masks.astype("<u8").tobytes()], pa.binary()), pa.array([member.sum(axis=1).astype("<i8").tobytes()], pa.binary())], names=["block", "masks", "filled"])

        for batch in batches:
            for k, i, raw in zip(*(batch.column(c).to_pylist() for c in ("block", "language", "counts")), strict=True):
                if k != here:
                    if here is not None:
                        yield done()
                    here, counts = k, np.zeros((len(totals), block), np.int64)
                counts[i] += np.frombuffer(raw, "<i8")
        if here is not None:
            yield done()

    masks, filled = np.zeros((looks, words, size), np.uint64), np.zeros((looks, len(totals)), np.int64)
    parts = docs.select("lang", "text").mapInArrow(count, "block int, language int, counts binary")
    for k, raw, full in parts.repartition("block").sortWithinPartitions("block").mapInArrow(mask, "block int, masks binary, filled binary").collect():
        look, at = divmod(k * block, size)
        masks[look, :, at : at + block] = np.frombuffer(raw, "<u8").reshape(words, block)
        filled[look] += np.frombuffer(full, "<i8")
    return masks, filled


class Filters:
    """Bit-sliced filters of the languages, in code point order."""

    def __init__(self, languages: list[str], masks: np.ndarray, filled: np.ndarray, n: int = NGRAM):
        self.languages, self.masks, self.n = languages, masks, n
        self.bits = masks.shape[2].bit_length() - 1
        self.by_chance = (filled / masks.shape[2]).prod(axis=0)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language and a score from 0 to 1 for each text."""
        (first, second), bounds = ngram_places(column, self.bits, self.n)
        total = np.diff(bounds)
        right = np.zeros((len(self.languages), len(total)))
        for i in range(len(self.languages)):
            if i % WORD == 0:
                hit = self.masks[0, i // WORD][first] & self.masks[1, i // WORD][second]
            count = doc_sums((hit >> np.uint64(i % WORD)) & np.uint64(1), bounds)
            right[i] = np.maximum(count - total * self.by_chance[i], 0) / max(1e-9, 1 - self.by_chance[i])
        names, scores = [], np.zeros(len(total))
        for d, text in enumerate(column.to_pylist()):
            if not text or not self.languages or not _LETTER.search(text):
                names.append(UNKNOWN)
                continue
            best = int(right[:, d].argmax())  # the first in code point order on ties
            names.append(self.languages[best])
            whole = right[:, d].sum()
            scores[d] = right[best, d] / whole if whole else 0.0
        return names, scores


def learn(docs: DataFrame, *, share: float = SHARE, bits: int = TABLE_BITS, n: int = NGRAM) -> Filters:
    """Filters from all rows of (lang, text) that have both."""
    labelled = docs.select("lang", "text").filter("lang is not null and text is not null")
    grams = F.greatest(F.octet_length("text") - (n - 1), F.lit(0)).cast("long")
    totals = {r[0]: r[1] for r in labelled.groupBy("lang").agg(F.sum(grams)).orderBy("lang").collect()}  # one row a language
    return Filters(list(totals), *ngram_masks(labelled, totals, share, bits, n), n)


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS, share: float = SHARE, bits: int = TABLE_BITS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``.

    Learns from rows that are not held out. Defined cases: a null text or one without a
    letter is ``und`` with score 0; a text with letters but no known n-gram is the first
    language in code point order, with score 0, as a tie goes to the first; any number of
    languages can be learned, at 4 MB of masks for each 64; without a learning row all are ``und``; a null
    doc_id counts as empty text for the fold; repeated rows count each; an empty table gives
    no rows; other columns are not read, and prediction reads the text alone.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.withColumn("held_out", held_out(F.col("doc_id"), folds))
    model = docs.sparkSession.sparkContext.broadcast(learn(rows.filter("not held_out"), share=share, bits=bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            names, scores = model.value.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def fold_of(doc_id: int, folds: int = FOLDS) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds
