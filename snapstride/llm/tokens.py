"""Token ids of whole batches from a tokenizers file, each distinct part encoded once.

A text is cut, in Arrow, at places where a pre-token ends whatever stands around them; its
ids are then those of its parts, one after the other. The distinct parts of a batch are
encoded by the tokenizers library, remembered, and their ids gathered back. The places are

- a space after a character that is not white space,
- between an ASCII letter and a full stop or comma,
- a line end after an ASCII letter or a mark and before an ASCII letter.

Texts with a cut for which this does not hold are encoded whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .words import doc_sums, plain

#: Parts whose ids a worker remembers, in two generations: the older half is forgotten first.
REMEMBERED = 500_000
#: Distinct parts are encoded so many to a call, joined, and cut apart again.
JOINED = 500
#: Stands between joined parts where a space belongs to neither of them.
FENCE = "\x01"
#: Marks the cuts in a text.
CUT = "\x1f"

_encoders: dict[tuple[str, bool], "Encoder"] = {}


def encoder(path: str, spaced: bool) -> "Encoder":
    """The worker's encoder for a file; ``spaced``: a space belongs to the part after it."""
    if (path, spaced) not in _encoders:
        _encoders[path, spaced] = Encoder(path, spaced)
    return _encoders[path, spaced]


@dataclass
class Ids:
    """Ids of a batch of texts, one after the other, and offsets by text."""

    ids: np.ndarray
    offs: np.ndarray


class Encoder:
    """spaced: byte-level pre-tokens, which may begin with a space; else words without blanks."""

    def __init__(self, path: str, spaced: bool):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.spaced = spaced
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        # tokens that begin a part of a kind, and no other token inside one
        self.space = np.array([x.startswith("\u0120") for x in names])
        self.line = np.array([x == "\u010a" for x in names])
        self.fence = np.zeros(size, bool)
        self.fence[self._encode([FENCE])[0][-1]] = not spaced

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _alone(self, parts: list[str]) -> list[bytes]:
        return [x.tobytes() for x in self._encode(parts)]

    def _joined(self, parts: list[str], between: str, border: np.ndarray) -> list[bytes]:
        """Ids of each part from one call for JOINED of them, cut at the border tokens.

        Without ``between`` a border token begins each part; else it stands between two.
        """
        groups = [parts[i : i + JOINED] for i in range(0, len(parts), JOINED)]
        out: list[bytes] = []
        for group, ids in zip(groups, self._encode([between.join(g) for g in groups]), strict=True):
            at = np.flatnonzero(border[ids])
            begins, ends = (np.append(0, at + 1), np.append(at, len(ids))) if between else (at, np.append(at[1:], len(ids)))
            if len(begins) != len(group) or begins[0]:  # never seen; then one by one
                out += self._alone(group)
                continue
            raw = ids.tobytes()
            out += [raw[b:e] for b, e in zip((4 * begins).tolist(), (4 * ends).tolist(), strict=True)]
        return out

    def _new(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts, by kind: those whose ends show when joined, and the others."""
        if not self.spaced:
            plain_, odd = [p for p in parts if FENCE not in p], [p for p in parts if FENCE in p]
            ways = [(plain_, lambda x: self._joined(x, f" {FENCE} ", self.fence)), (odd, self._alone)]
        else:
            closed = [p and not p[-1].isspace() for p in parts]
            spaced = [p for p, c in zip(parts, closed, strict=True) if c and p[0] == " "]
            lines = [p for p, c in zip(parts, closed, strict=True) if c and p[0] == "\n" and "\n" not in p[1:] and p[1:2].isascii() and p[1:2].isalpha()]
            rest = set(parts).difference(spaced, lines)
            ways = [(spaced, lambda x: self._joined(x, "", self.space)), (lines, lambda x: self._joined(x, "", self.line)), (sorted(rest), self._alone)]
        out: dict[str, bytes] = {}
        for some, way in ways:
            if some:
                out.update(zip(some, way(some), strict=True))
        return out

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct parts; those not yet known are encoded and remembered."""
        young, old = self.young, self.old
        found = list(map(young.get, parts))
        missing = [i for i, x in enumerate(found) if x is None]
        if old:
            for i in missing:
                if (ids := old.get(parts[i])) is not None:
                    found[i] = young[parts[i]] = ids
            missing = [i for i in missing if found[i] is None]
        new = self._new([parts[i] for i in missing])
        for i in missing:
            found[i] = new[parts[i]]
        young.update(new)
        if len(young) > REMEMBERED // 2:
            self.old, self.young = young, {}
        return found

    def _cut(self, column: pa.Array) -> tuple[pa.Array, str]:
        """The column with its cuts marked, and the mark."""
        if not self.spaced:
            if pc.any(pc.match_substring(column, "<|")).as_py():
                return column, " "
            # this tokenizer lowers case anyway
            return pc.replace_substring_regex(pc.ascii_lower(column), "([a-z])([.,])", r"\1 \2"), " "
        column = pc.replace_substring(column, " ", f"{CUT} ")
        column = pc.replace_substring_regex(column, "([A-Za-z])([.,])", rf"\1{CUT}\2")
        return pc.replace_substring_regex(column, "([A-Za-z.,!?])\n([A-Za-z])", f"\\1{CUT}\n\\2"), CUT

    def texts(self, column: pa.Array, end: int | None = None) -> Ids:
        """Ids of each text, with ``end`` after each if given; null counts as empty."""
        column = plain(column)
        n = len(column)
        if n == 0:
            return Ids(np.zeros(0, np.uint32), np.zeros(1, np.int64))
        lists = pc.split_pattern(*self._cut(column))
        offs = np.asarray(lists.offsets).astype(np.int64)
        offs = offs - offs[0]
        coded = lists.flatten().dictionary_encode()
        parts, index = coded.dictionary.to_pylist(), np.asarray(coded.indices)
        if not self.spaced:
            return self._gather(self._parts(parts), index, offs, end)
        # after white space a space need not begin a pre-token; nothing follows a text's last part
        open_end = np.asarray(pc.utf8_is_space(pc.utf8_slice_codeunits(coded.dictionary, -1)))[index]
        open_end[offs[1:] - 1] = False
        whole = np.logical_or.reduceat(open_end, offs[:-1]) | np.asarray(pc.match_substring(column, CUT))
        if not whole.any():
            return self._gather(self._parts(parts), index, offs, end)
        keep = ~np.repeat(whole, np.diff(offs))
        used = np.unique(index[keep])
        slot = np.zeros(len(parts), np.int32)
        slot[used] = np.arange(len(used), dtype=np.int32)
        entry, firsts = slot[index], offs[:-1][whole]
        entry[firsts] = len(used) + np.arange(len(firsts), dtype=np.int32)
        keep[firsts] = True
        pieces = self._parts([parts[i] for i in used.tolist()]) + self._alone(column.filter(pa.array(whole)).to_pylist())
        return self._gather(pieces, entry[keep], np.concatenate([[0], np.cumsum(doc_sums(keep, offs))]), end)

    @staticmethod
    def _gather(pieces: list[bytes], entry: np.ndarray, offs: np.ndarray, end: int | None) -> Ids:
        """The ids of ``pieces[entry]``; ``offs`` part the entries into texts."""
        if end is not None:
            entry = np.insert(entry, offs[1:], len(pieces))
            offs = offs + np.arange(len(offs))
            pieces = [*pieces, np.array([end], np.uint32).tobytes()]
        lens = np.fromiter(map(len, pieces), np.int32, len(pieces)) // 4
        begin = np.cumsum(lens, dtype=np.int32) - lens
        flat = np.frombuffer(b"".join(pieces), np.uint32)
        size = lens[entry]
        total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        at = np.repeat(begin[entry] - total[:-1].astype(np.int32), size)
        at += np.arange(len(at), dtype=np.int32)
        return Ids(flat[at], total[offs])

