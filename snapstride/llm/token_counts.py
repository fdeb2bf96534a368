"""Token counts by a sentencepiece BPE model, huge documents in overlapping chunks.

A huge text is encoded in chunks that overlap. Two neighbours are spliced at a place where
both have a token border, if the token that ends there in the one and the token that begins
there in the other form a compatible pair: encoded by themselves, the two stay two. That is
proof enough. Merges of BPE go by score, then from left to right, so what happens inside two
adjacent tokens does not depend on what stands around them as long as no merge crosses a
border; the first merge that crossed one in the whole text would cross it in that pair too.
A sequence of tokens is therefore the encoding of its text if all its adjacent pairs are
compatible, and in an encoding they all are; only the pair at the splice is left to check.
It needs no white space: scripts without it and runs of one character are spliced as well.

Where an overlap has no such place it is doubled, at most back to the last splice; if there
is none even then, the text is encoded whole. Work is linear in the text in every case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import bounded
from .words import plain

HUGE = 32_768
CHUNK = 16_384
OVERLAP = 256
LIMIT = 4096
MARK = "▁"

_models: dict[str, "Counter"] = {}


def counter(path: str) -> "Counter":
    if path not in _models:
        _models[path] = Counter(path)
    return _models[path]


class Part:
    """The tokens of ``text[start:end]``, encoded as if nothing stood around it."""

    def __init__(self, ids: np.ndarray, start: int, sizes: np.ndarray, later: np.ndarray):
        self.ids = ids
        at = start + np.cumsum(sizes[ids]) - sizes[ids]
        #: tokens that begin a piece or a character (not its second byte), and where
        self.first = np.flatnonzero(~later[ids])
        self.at = at[self.first]

    def tokens_before(self, place: int) -> int:
        i = int(np.searchsorted(self.at, place))
        return int(self.first[i]) if i < len(self.first) else len(self.ids)


class Counter:
    def __init__(self, path: str):
        model = self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(size)]
        byte = np.array([model.is_byte(i) for i in range(size)])
        odd = np.array([model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)])
        self.merged = byte | odd  # no merge makes these
        self.score = {self.names[i]: model.get_score(i) for i in np.flatnonzero(~self.merged).tolist()}
        #: bytes 0x80 to 0xBF go on with the character of an earlier token
        self.later = np.array([b and 0x80 <= int(n[1:-1], 16) < 0xC0 for n, b in zip(self.names, byte, strict=True)])
        self.sizes = np.where(byte, np.where(self.later, 0, 1), [len(n) for n in self.names]).astype(np.int64)
        known = set("".join(self.score))
        #: a character of no piece: nothing merges with it, so it keeps the library's own first mark off a chunk
        self.fence = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in known)
        self.lead = len(model.encode(self.fence))
        self.pairs: dict[tuple[int, int], bool] = {}

    def part(self, text: str, start: int, end: int) -> Part | None:
        """Tokens of a chunk; None if some character has neither a piece nor bytes."""
        ids = np.array(self.model.encode(self.fence + text[start:end])[self.lead :], np.int64)
        return None if (ids == self.model.unk_id()).any() else Part(ids, start, self.sizes, self.later)

    def compatible(self, left: int, right: int) -> bool:
        """Whether two pieces, encoded by themselves, stay these two."""
        key = (left, right)
        if key not in self.pairs:
            if len(self.pairs) > 1 << 20:
                self.pairs.clear()
            self.pairs[key] = bool(self.merged[left] or self.merged[right]) or self._merge(self.names[left] + self.names[right]) == [self.names[left], self.names[right]]
        return self.pairs[key]

    def _merge(self, text: str) -> list[str]:
        """The pieces of a short text: the best-scored merge first, of equal ones the leftmost."""
        parts = list(text)
        while True:
            best, at = max(((self.score.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(-np.inf, 0))
            if best == -np.inf:
                return parts
            parts[-at : 2 - at] = ["".join(parts[-at : 2 - at])]

    def splice(self, left: Part, right: Part, low: int, high: int) -> int | None:
        """The last place in [low, high] where the two parts' tokens meet in a compatible pair."""
        both = np.intersect1d(left.at, right.at, assume_unique=True)
        for place in both[(both >= low) & (both <= high)][::-1].tolist():
            i, j = left.tokens_before(place), right.tokens_before(place)
            if i and self.compatible(int(left.ids[i - 1]), int(right.ids[j])):
                return place
        return None

    def count_huge(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        spaced = MARK + text.replace(" ", MARK)
        if self.model.normalize(text) != spaced:  # chunks would be normalised otherwise than the text
            return len(self.model.encode(text))
        n, border, total = len(spaced), 0, 0
        end = min(n, chunk)
        here = self.part(spaced, 0, end)
        while here is not None and end < n:
            wide, cut, after = overlap, None, min(n, end + chunk)
            while cut is None:
                # from a border of this chunk, so that even text without any landmark meets there
                k = int(np.searchsorted(here.at, max(border + 1, end - wide), "right")) - 1
                low = int(here.at[max(k, 0)])
                ahead = self.part(spaced, low, after)
                if ahead is None:
                    return len(self.model.encode(text))
                cut = self.splice(here, ahead, max(low, border + 1), end)
                if cut is None and low <= border + 1:
                    return len(self.model.encode(text))
                wide *= 2
            total += here.tokens_before(cut) - here.tokens_before(border)
            here, border, end = ahead, cut, after
        if here is None:
            return len(self.model.encode(text))
        return total + len(here.ids) - here.tokens_before(border)

    def counts(self, texts: list[str], huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        usual = [i for i, t in enumerate(texts) if len(t) <= huge]
        out[usual] = [len(x) for x in self.model.encode([texts[i] for i in usual], num_threads=1)] if usual else []
        for i in set(range(len(texts))).difference(usual):
            out[i] = self.count_huge(texts[i], chunk, overlap)
        return out


def count_tokens(
    docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``, without a shuffle.

    Counts are those of the library for the whole text. Defined cases: a null text counts as
    empty and has no tokens; a huge text that the model normalises, or that has no provable
    splice, is encoded whole; repeated rows are counted one by one; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_here = counter(model)
        for batch in bounded(batches):
            text = plain(batch.column("text"))
            n = model_here.counts(text.to_pylist(), huge, chunk, overlap)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.binary_length(text).cast(pa.int64()), pa.array(n), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
