"""Words, shingles and per-document sums over the UTF-8 bytes of Arrow string columns.

A word is a longest run without the six ASCII blanks (0x20, 0x09 to 0x0D). All work is on
whole batches in numpy; memory follows the batch, hashing runs in windows of about a
megabyte, so one very long text costs no more than many short ones of the same length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

WINDOW_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def plain(column: pa.Array) -> pa.Array:
    """The column as large strings without nulls, its offsets counted from 0.

    A cast of a slice keeps the slice's first offset, which some compute functions then
    read as 0; here the buffers are cut to the slice without a copy of the text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offs, data = column.buffers()
    at = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if data is None or not len(at) or at[-1] == at[0]:
        data, at = pa.py_buffer(b""), at - at[0]
    else:
        data, at = data.slice(int(at[0]), int(at[-1] - at[0])), at - at[0]
    return pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer(at), data])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and len + 1 offsets into them; null counts as empty."""
    column = plain(column)
    _, offs, data = column.buffers()
    return np.frombuffer(data, np.uint8), np.frombuffer(offs, np.int64)


def doc_sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive offsets."""
    run = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=run[1:])
    return run[offs[1:]] - run[offs[:-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, WINDOW_BYTES + 4096)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of a batch: byte ranges, and the first word of each document."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray  # len(docs) + 1 offsets into starts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.firsts)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.firsts) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """One 64-bit value for each word, equal for equal bytes."""
        out = np.empty(len(self.starts), np.uint64)
        i = 0
        while i < len(out):
            base = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, base + WINDOW_BYTES, "right")))
            seg = self.data[base : self.ends[j - 1]]
            up, down = _power_tables(len(seg) + 1)
            run = np.zeros(len(seg) + 1, np.uint64)
            np.cumsum((seg.astype(np.uint64) + np.uint64(1)) * up[: len(seg)], out=run[1:])
            s, e = self.starts[i:j] - base, self.ends[i:j] - base
            out[i:j] = (run[e] - run[s]) * down[s]
            i = j
        return mix(out)


def find_words(data: np.ndarray, offs: np.ndarray) -> Words:
    inside = ~BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    stops[:-1] &= ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(begins)
    return Words(data, starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offs))


def shingles(words: np.ndarray, firsts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside one document, and offsets by document.

    A document of fewer than ``n`` words, but any, has one: all its words.
    """
    counts = np.diff(firsts)
    total = len(words)
    run = np.zeros(total, np.uint64)
    for k in range(n):
        run[: max(0, total - k)] += words[k:] * np.uint64((2 * k + 1) * 0xD1342543DE82EF95 % (1 << 64))
    out = mix(run)
    have = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    offs = np.concatenate([[0], np.cumsum(have)])
    at = np.arange(offs[-1]) - np.repeat(offs[:-1] - firsts[:-1], have)
    # short documents: their run would reach into the next one
    short = np.flatnonzero((counts > 0) & (counts < n))
    out = out[at]
    for d in short:
        own = words[firsts[d] : firsts[d + 1]]
        scale = (2 * np.arange(len(own), dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
        out[offs[d]] = mix(np.array([(own * scale).sum(dtype=np.uint64) + np.uint64(len(own))]))[0]
    return out, offs


def slices(offs: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Ranges of documents that hold about ``size`` units each, at least one document."""
    out, i, n = [], 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        out.append((i, min(j, n)))
        i = out[-1][1]
    return out
