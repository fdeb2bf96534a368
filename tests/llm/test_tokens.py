import random
import time
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from snapstride.llm import binary_ids, packing, token_counts, tokens
from snapstride.session import shared_dir

WORD, BYTE, PIECE = (P.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


library = lru_cache(Tokenizer.from_file)


def ids_of(path, text):
    return np.array([*library(path).encode(text or "", add_special_tokens=False).ids, 2], "<u4")


@pytest.mark.parametrize(("path", "spaced"), [(WORD, False), (BYTE, True)])
def test_ids_are_those_of_the_library(path, spaced, odd_texts, texts):
    every = [*odd_texts[:11], *odd_texts[13:], *list(texts.values())[:200]]
    coder = tokens.Encoder(path, spaced)
    column = pa.array(every, pa.string())
    for part in (column, column.slice(3, 40), column):  # from slices, and from memory
        got = coder.texts(part, 2)
        for i, text in enumerate(part.to_pylist()):
            assert got.ids[got.offs[i] : got.offs[i + 1]].tolist() == ids_of(path, text).tolist(), repr(text)[:80]
    assert len(coder.texts(pa.array([], pa.string()), 2).ids) == 0


@pytest.mark.parametrize(("path", "spaced"), [(WORD, False), (BYTE, True)])
def test_ids_of_random_strings(path, spaced):
    rng = random.Random(3)
    signs = ["a", "B", "c", " ", " ", "\n", "\n", ".", ",", "!", "'s", "\t", "\r", "é", "1", "\x1f", "\x01", "\xa0", "\u3000", "<|endoftext|>", "漢", "  ", "\u0301", "\x85", "\x1c", "Σ", "-"]
    every = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    coder = tokens.Encoder(path, spaced)
    for k in range(0, len(every), 500):
        got = coder.texts(pa.array(every[k : k + 500]), 2)
        for i, text in enumerate(every[k : k + 500]):
            assert got.ids[got.offs[i] : got.offs[i + 1]].tolist() == ids_of(path, text).tolist(), repr(text)


def assert_packed(pieces, wanted, window=4096):
    """Each document's ids lie in exactly one piece, and sequences are gapless."""
    seen = {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        ids = wanted[r.doc_id]
        at = seen.get(r.doc_id, 0)
        assert r.start == at and r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
        seen[r.doc_id] = at + r.length
    assert seen == {d: len(ids) for d, ids in wanted.items()}
    fill = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= window
    return sum(fill.values()) / (window * len(fill))


def test_packing_of_all_documents(documents, texts):
    wanted = {d: ids_of(WORD, t) for d, t in texts.items()}
    assert assert_packed(packing.pack(documents, WORD).collect(), wanted) > 0.97
    small = packing.pack(documents.repartition(5, "doc_id"), WORD, open_windows=4, merged_partitions=2, window=512, least_cut=16).collect()
    assert assert_packed(small, wanted, 512) > 0.95


def test_packing_of_odd_and_no_texts(odd, odd_texts, empty):
    wanted = {i: ids_of(WORD, t) for i, t in enumerate(odd_texts)}
    assert_packed(packing.pack(odd, WORD).collect(), wanted)
    assert packing.pack(empty, WORD).count() == 0


def test_packer_holds_a_fixed_number_of_windows():
    packer = packing.Packer(window=10, open_windows=3, least_cut=100)
    rng = np.random.default_rng(0)
    done = []
    for n in rng.integers(1, 11, 500).tolist():
        done += packer.place(n, n)
        assert len(packer.slots) <= 3 and len(packer.free) == len(packer.slots)
    done += packer.rest()
    assert all(sum(n for n, _ in w) <= 10 for w in done) and sum(len(w) for w in done) == 500


def test_counts_are_those_of_the_library(odd, odd_texts, documents, texts, empty):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for df, wanted in ((odd, dict(enumerate(odd_texts))), (documents, texts)):
        for r in token_counts.count_tokens(df, PIECE, huge=2000, chunk=900, overlap=8).collect():
            n = len(model.encode(wanted[r.doc_id] or ""))
            assert (r.n_tokens, r.over_limit, r.n_bytes) == (n, n > 4096, len((wanted[r.doc_id] or "").encode()))
    assert token_counts.count_tokens(empty, PIECE).count() == 0


def test_huge_texts_without_a_border_are_still_right():
    model, c = sentencepiece.SentencePieceProcessor(model_file=PIECE), token_counts.Counter(PIECE)
    rng = np.random.default_rng(4)
    mixed = ["".join(rng.choice(list(kind), 2500)) for kind in ("ab", "aeiou nrst", "0123456789", "漢字中国人ab ", "  \t\n", "ééàö\u0301x", "=-_", "\U00020000a")]
    for text in ("q" * 3000, " " * 700 + "x", "漢字 " * 90 + "ﬀ" * 300, "▁ ▁a ▁" * 90, "the cat  sat" * 100 + "q" * 900 + " end " * 30, f"{c.fence}a" * 400, *mixed):
        for chunk, overlap in ((64, 4), (100, 16), (37, 1), (600, 40)):
            assert c.count_huge(text, chunk, overlap) == len(model.encode(text))


def test_compatible_pairs_are_those_the_library_keeps():
    c = token_counts.Counter(PIECE)
    rng = np.random.default_rng(6)
    usable = [i for i in range(len(c.names)) if not c.merged[i]]
    for i, j in rng.choice(usable, (3000, 2)).tolist():
        own = all(c.model.encode(c.fence + c.names[k])[c.lead :] == [k] for k in (i, j))
        kept = c.model.encode(c.fence + c.names[i] + c.names[j])[c.lead :] == [i, j]
        assert not own or c.compatible(i, j) == kept


def _text_of(kind, n):
    rng = np.random.default_rng(9)
    if kind == "han":
        return "".join(map(chr, rng.integers(0x4E00, 0x9FFF, n)))
    return "".join(rng.choice(list("ab"), n)) if kind == "letters" else "a" * n


@pytest.mark.parametrize("kind", ["han", "letters", "run"])
def test_a_million_characters_without_a_space_take_linear_time(kind):
    c = token_counts.Counter(PIECE)
    text = _text_of(kind, 1_000_000)
    began = time.process_time()
    wanted = len(c.model.encode(text))
    library = time.process_time() - began
    began = time.process_time()
    assert c.counts([text]).tolist() == [wanted]
    assert time.process_time() - began < 10 * library


def test_planes_round_trip():
    class Store:
        def __init__(self):
            self.data, self.at = b"", 0

        def write(self, x):
            self.data += x

        def close(self):
            pass

        def size(self):
            return len(self.data)

        def seek(self, at):
            self.at = at

        def read(self, n):
            return self.data[self.at : self.at + n]

    rng = np.random.default_rng(1)
    for counts in ([], [0], [1, 0, 5000, 3], [256, 256], [1] * 700):
        store, ids = Store(), rng.integers(0, 1 << 32, sum(counts), dtype=np.uint32)
        w = binary_ids.PlaneWriter(store, block=256)
        w.add(np.arange(len(counts)), np.zeros(len(counts)), np.array(counts, np.int64), ids)
        assert w.close() == len(store.data)
        r = binary_ids.PlaneReader(store)
        assert r.counts.tolist() == counts
        assert np.concatenate([np.zeros(0, np.uint32), *[r.block(i) for i in range(len(r.index))]]).tolist() == ids.tolist()
        bounds = np.cumsum([0, *counts])
        assert r.crcs().tolist() == [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds, bounds[1:])]


def test_ids_from_files(documents, texts, odd, odd_texts, empty):
    for df, wanted in ((documents, texts), (odd, dict(enumerate(odd_texts)))):
        at = 0
        for r in sorted(binary_ids.ids_round_trip(df.repartition(3), BYTE, block=1000).collect(), key=lambda r: r.doc_id):
            ids = ids_of(BYTE, wanted[r.doc_id])
            assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
            at += len(ids)
        assert at
    assert binary_ids.ids_round_trip(empty, BYTE).count() == 0


def test_null_and_repeated_ids_are_kept(spark):
    df = spark.createDataFrame([(None, "a"), (2, "b"), (2, "a"), (1, "c")], "doc_id long, text string")
    manifest = binary_ids.write_ids(df, BYTE, shared_dir(spark, "ids"))
    rows = sorted(binary_ids.read_ids(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 2]
    assert packing.pack(df.withColumn("start", F.lit("clash")), WORD).count() == 4
