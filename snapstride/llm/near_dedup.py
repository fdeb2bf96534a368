"""Near-duplicate detection by improved consistent weighted sampling.

Documents are sets of five-word shingles with TF-IDF weights. Document frequencies come
from one pass over all documents into a count sketch of fixed size; what a bucket holds of
other shingles on average is taken away, and the weight depends on the share of documents
only, so that it is alike at every size. Per document, consistent samples of its weighted
shingles are grouped into bands; documents that agree on a band are candidates, and each
candidate pair is verified by the weighted Jaccard similarity of its whole texts.

Documents with the same shingles and counts are one from the start, so copies cost nothing.
Small buckets give all their pairs. In a large one every member meets the leader, the member
that shares most buckets with others. Where a large bucket then still holds several classes,
members outside its largest class are compared with all others, block by block, so that texts
move by block. If they are too many for that, a prefix filter deals them out first: two
documents of similarity t share a shingle among the rarest that make up 1 - t of the heavier
one's weight and (1 - t) / (1 + t) of the lighter one's, so texts of one template are brought
together by what they have besides it. No pair that agrees on a band is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import bounded
from .components import connected
from .idfilter import id_filter, passing, without
from .scratch import row_keys, staged
from .words import LOWER, find_words, mix, plain, shingles, slices, text_bytes

N = 5
SIMILARITY = 0.8
BANDS, ROWS = 14, 4
SKETCH_BITS = 20
SKETCH_BLOCK = 1 << 12
#: Shingles in fewer than one of so many documents all have the full weight.
RARE = 1024
#: Buckets up to this size give all their pairs.
SMALL = 8
#: Members and characters of a block that meets a leader, or another block.
BLOCK = 256
#: Members of one bucket outside its largest class that are still compared block by block.
VAST = 1024
BLOCK_CHARS = 4 << 20
_SLICE_WORDS = 200_000


def doc_shingles(column: pa.Array, n: int = N) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of a batch: first document, shingle hashes, counts, offsets by document.

    Hashes have 48 bits and ascend in each document. A-Z count as a-z.
    """
    data, offs = text_bytes(column)
    words = find_words(LOWER[data], offs)
    hashes = words.hashes()
    for i, j in slices(words.firsts, _SLICE_WORDS):
        firsts = words.firsts[i : j + 1]
        found, at = shingles(hashes[firsts[0] : firsts[-1]], firsts - firsts[0], n)
        for k in range(0, j - i, 1 << 16):  # document numbers take 16 bits
            m = min(j - i, k + (1 << 16))
            doc = np.repeat(np.arange(m - k, dtype=np.uint64), np.diff(at[k : m + 1]))
            keys = np.sort((doc << np.uint64(48)) | (found[at[k] : at[m]] >> np.uint64(16)))
            new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            counts = np.diff(np.append(new, len(keys)))
            keys = keys[new]
            bounds = np.searchsorted(keys, np.arange(m - k + 1, dtype=np.uint64) << np.uint64(48)) if m - k < 1 << 16 else np.append(np.searchsorted(keys, np.arange(m - k, dtype=np.uint64) << np.uint64(48)), len(keys))
            yield i + k, keys & np.uint64((1 << 48) - 1), counts, bounds


def frequency_sketch(docs: DataFrame, bits: int = SKETCH_BITS, n: int = N) -> tuple[np.ndarray, int]:
    """Documents by shingle bucket, and all documents; docs has a column text.

    The result has 2**bits numbers at any corpus size. Partial tables are added up by streams
    that hold one block table each.
    """
    blocks = max(1, (1 << bits) // SKETCH_BLOCK)
    size = (1 << bits) // blocks

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = np.zeros(1 << bits, np.int64), 0
        for batch in bounded(batches):
            total += batch.num_rows
            for _, keys, _, _ in doc_shingles(batch.column("text"), n):
                table += np.bincount((keys & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
        if total:
            rows = table.reshape(blocks, size)
            used = np.flatnonzero(rows.any(axis=1))
            yield _blocks([-1, *used.tolist()], [np.array([total]), *rows[used]])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                part = np.frombuffer(raw, "<i8")
                sums[k] = sums[k] + part if k in sums else part
        yield _blocks(list(sums), list(sums.values()))

    schema = "block int, counts binary"
    sums = docs.select("text").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema)
    table, total = np.zeros(1 << bits, np.int64), 0
    for k, raw in sums.collect():
        if k < 0:
            total = int(np.frombuffer(raw, "<i8")[0])
        else:
            table[k * size : (k + 1) * size] = np.frombuffer(raw, "<i8")
    return table, total


def _blocks(keys: list[int], rows: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([r.astype("<i8").tobytes() for r in rows], pa.binary())], names=["block", "counts"])


def idf_table(sketch: np.ndarray, total: int) -> np.ndarray:
    """Weights by bucket: from 1 (a shingle of all documents) to 2 (of one in RARE or fewer)."""
    own = np.maximum(sketch - sketch.mean(), 1)
    return (1 + np.clip(np.log(max(1, total) / own) / np.log(RARE), 0, 1)).astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling: per draw, a shingle of each document.

    Draws r and c from Gamma(2, 1) and b from (0, 1) come from fixed tables, indexed by bits
    of a hash of (shingle, draw); ties go to the smaller shingle hash.
    """

    def __init__(self, draws: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.keys = rng.integers(1, 1 << 63, draws, dtype=np.uint64) | np.uint64(1)
        self.r = np.sort(rng.gamma(2.0, 1.0, 1 << 12)).astype(np.float32)
        rng.shuffle(self.r)
        self.log_c = np.log(np.maximum(rng.gamma(2.0, 1.0, 1 << 16), 1e-9)).astype(np.float32)

    def samples(self, keys: np.ndarray, weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """One row per document with a shingle, a 64-bit sample per draw."""
        have = np.flatnonzero(np.diff(bounds))
        begins = bounds[:-1][have]
        sizes = np.diff(bounds)[have]
        log_w = np.log(weights).astype(np.float32)
        out = np.empty((len(have), len(self.keys)), np.uint64)
        for k, key in enumerate(self.keys):
            z = (keys + key) * key
            z ^= z >> np.uint64(31)
            z *= np.uint64(0x94D049BB133111EB)
            r = self.r[(z >> np.uint64(52)).astype(np.int64)]
            b = ((z >> np.uint64(40)) & np.uint64(0xFFF)).astype(np.float32) * np.float32(1 / 4096)
            t = np.floor(log_w / r + b)
            log_a = self.log_c[((z >> np.uint64(24)) & np.uint64(0xFFFF)).astype(np.int64)] - r * (t - b) - r
            least = np.minimum.reduceat(log_a, begins)
            at = np.flatnonzero(log_a == np.repeat(least, sizes))
            first = at[np.searchsorted(at, begins)]
            out[:, k] = mix(keys[first] ^ (t[first].astype(np.int64).astype(np.uint64) << np.uint64(48)))
        return out


def signatures(docs: DataFrame, weights, bands: int = BANDS, rows: int = ROWS, n: int = N) -> DataFrame:
    """doc_id, sig (equal for equal shingles and counts), bands; both null without a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.value
        low = np.uint64(len(table) - 1)
        sampler = Sampler(bands * rows)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in bounded(batches):
            ids = batch.column("doc_id")
            for first, keys, counts, bounds in doc_shingles(batch.column("text"), n):
                have = np.flatnonzero(np.diff(bounds))
                sig: list = [None] * (len(bounds) - 1)
                codes: list = [None] * (len(bounds) - 1)
                if len(have):
                    whole = [np.add.reduceat(mix(keys * np.uint64(m) + counts.astype(np.uint64)), bounds[:-1][have]) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
                    drawn = sampler.samples(keys, table[(keys & low).astype(np.int64)] * counts.astype(np.float32), bounds)
                    band = np.zeros((len(have), bands), np.uint64)
                    for k in range(rows):
                        band = mix(band + drawn[:, k::rows])
                    band = (band ^ salt).view(np.int64)
                    both = np.stack(whole, axis=1).astype("<u8")
                    for d, s, b in zip(have.tolist(), both, band.tolist(), strict=True):
                        sig[d], codes[d] = s.tobytes(), b
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(bounds) - 1), pa.array(sig, pa.binary()), pa.array(codes, pa.list_(pa.int64()))], names=["doc_id", "sig", "bands"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, sig binary, bands array<long>")


def weighted_jaccard(a: tuple, b: tuple) -> float:
    """Of two (ascending keys, weights) vectors."""
    ka, wa = a
    kb, wb = b
    if not len(ka) or not len(kb):
        return 0.0
    at = np.minimum(np.searchsorted(ka, kb), len(ka) - 1)
    hit = ka[at] == kb
    low = np.minimum(wa[at[hit]], wb[hit]).sum(dtype=np.float64)
    return float(low / (wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64) - low))


def _vectors(column: pa.Array, table: np.ndarray, n: int) -> list[tuple]:
    """(shingles, weights) of each text; equal texts of a batch are read once."""
    coded = plain(column).dictionary_encode()
    low = np.uint64(len(table) - 1)
    out = []
    for _, keys, counts, bounds in doc_shingles(coded.dictionary, n):
        w = table[(keys & low).astype(np.int64)] * counts.astype(np.float32)
        out += [(keys[s:e], w[s:e]) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
    return [out[i] for i in coded.indices.to_pylist()]


def verify(pairs: DataFrame, docs: DataFrame, weights, similarity: float = SIMILARITY, n: int = N) -> DataFrame:
    """The pairs (a, b) whose documents (doc_id, text) are at least that similar.

    pairs: a, b, n, where n bounds the pairs of one a. The pairs of an a are dealt into groups
    of about BLOCK; its text goes to each group once, those of the other documents follow. Of
    a doc_id with several texts any may be the similar one.
    """
    spark = pairs.sparkSession
    groups = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = pairs.select("a", "b", groups.alias("groups")).withColumn("grp", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int"))
    roles = dealt.select("a", "groups", "grp").distinct().select("a", "groups", "grp", F.col("a").alias("doc_id"), F.lit(False).alias("member"))
    roles = staged(roles.unionByName(dealt.select("a", "groups", "grp", F.col("b").alias("doc_id"), F.lit(True).alias("member"))), "roles")
    wanted = staged(roles.select("doc_id").distinct(), "wanted")
    some = passing(docs, "doc_id", spark.sparkContext.broadcast(id_filter(wanted)))
    # texts are not of bounded size, so they are never broadcast
    moved = some.join(roles.hint("merge"), "doc_id").repartition("a", "groups", "grp").sortWithinPartitions("a", "groups", "grp", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, leader = None, []
        for batch in bounded(batches):
            out: tuple = ([], [])
            columns = [batch.column(c).to_pylist() for c in ("a", "groups", "grp", "doc_id", "member")]
            for *group, doc, member, vector in zip(*columns, _vectors(batch.column("text"), weights.value, n), strict=True):
                if group != here:
                    here, leader = group, []
                if not member:
                    leader.append(vector)
                elif any(weighted_jaccard(x, vector) >= similarity for x in leader):
                    out[0].append(group[0])
                    out[1].append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

    return moved.select("a", "groups", "grp", "doc_id", "member", "text").mapInArrow(run, "a long, b long")


def _star_pairs(members: DataFrame) -> DataFrame:
    """First candidate pairs (a, b, n) from (key, id, n), n members to the key."""
    small = members.filter(F.col("n") <= SMALL).select("key", "id")
    within = small.alias("x").join(small.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")))
    within = within.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.lit(SMALL).cast("long").alias("n"))
    large = members.filter(F.col("n") > SMALL)
    strength = members.groupBy("id").agg(F.sum("n").alias("strength"))
    rank = F.struct("strength", -F.col("id"))
    leaders = large.join(strength, "id").groupBy("key").agg(F.max_by("id", rank).alias("leader"))
    # never broadcast: a hot bucket's rows are then split, and the buckets are of no bounded size
    stars = large.join(staged(leaders, "leaders").hint("merge"), "key").select(F.col("leader").alias("a"), F.col("id").alias("b"), "n").filter("a <> b")
    return within.unionByName(stars).groupBy("a", "b").agg(F.max("n").alias("n"))


def _rest(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, id, label, inner) of large buckets with more than one class; inner: in its largest."""
    large = members.filter(F.col("n") > SMALL).select("key", "id")
    named = large.join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    sizes = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    hubs = sizes.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("hub"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    return named.join(staged(hubs, "hubs").hint("merge"), "key").select("key", "id", "label", (F.col("label") == F.col("hub")).alias("inner"))


def prefixes(docs: DataFrame, weights, counts, similarity: float = SIMILARITY, n: int = N) -> DataFrame:
    """The prefix of each document (doc_id, label, text): shingle, id, label, whole, indexed.

    Shingles go by the broadcast bucket ``counts``, the rarest first, then by hash. Any pair
    that is similar enough has one in both prefixes, the lighter document's ``indexed``: what
    the two share lies behind their first common shingle, so from there on each has at least
    the weight that the two must share, t of the heavier one's and 2t / (1 + t) of the lighter
    one's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.uint64(len(weights.value) - 1)
        for batch in bounded(batches):
            rows: list = [[], [], [], []]
            for i, (keys, w) in enumerate(_vectors(batch.column("text"), weights.value, n)):
                if not len(keys):
                    continue
                order = np.lexsort((keys, counts.value[(keys & low).astype(np.int64)]))
                own = w[order].astype(np.float64)
                left = own[::-1].cumsum()[::-1]  # weight from here on
                k = int((left >= (similarity - 1e-6) * left[0]).sum())
                rows[0].append(keys[order[:k]].view(np.int64))
                rows[1].append(np.full(k, i))
                rows[2].append(np.full(k, left[0]))
                rows[3].append(left[:k] >= (2 * similarity / (1 + similarity) - 1e-6) * left[0])
            if rows[0]:
                key, i, whole, indexed = (np.concatenate(x) for x in rows)
                at = pa.array(i)
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("doc_id").take(at), batch.column("label").take(at), pa.array(whole), pa.array(indexed)], names=["key", "id", "label", "whole", "indexed"])

    return docs.select("doc_id", "label", "text").mapInArrow(run, "key long, id long, label long, whole double, indexed boolean")


def _rest_links(rest: DataFrame, heads: DataFrame, rows: DataFrame, weights, sketch_bits: int, similarity: float = SIMILARITY, n: int = N) -> DataFrame:
    """Links (a, b) that join all classes of ``rest`` with a similar pair between them in one bucket."""
    spark = rest.sparkSession
    ids = staged(rest.select(F.col("id").alias("doc_id")).distinct(), "rest-ids")
    some = passing(rows, "doc_id", spark.sparkContext.broadcast(id_filter(ids)))
    texts = staged(some.join(ids.hint("merge"), "doc_id", "left_semi"), "rest-texts")
    vast = staged(rest.groupBy("key").agg(F.count_if(~F.col("inner")).alias("others")).filter(F.col("others") > VAST).select("key"), "vast")
    if vast.isEmpty():
        return _block_links(rest.join(heads.select("id", "bands"), "id"), texts, weights, similarity, n)
    usual = rest.join(vast.hint("merge"), "key", "left_anti").join(heads.select("id", "bands"), "id")
    links = staged(_block_links(usual, texts, weights, similarity, n), "block-links")
    hard = rest.join(vast.hint("merge"), "key", "left_semi").select(F.col("id").alias("doc_id"), "label").distinct()
    return links.unionByName(_prefix_links(texts.join(staged(hard, "hard").hint("merge"), "doc_id"), weights, sketch_bits, similarity, n))


def _prefix_links(docs: DataFrame, weights, sketch_bits: int, similarity: float = SIMILARITY, n: int = N) -> DataFrame:
    """Links (a, b) that join all classes of (doc_id, label, text) with a similar pair between them."""
    spark = docs.sparkSession
    docs = staged(docs, "hard-texts")
    counts = spark.sparkContext.broadcast(frequency_sketch(docs, sketch_bits, n)[0])
    prefix = staged(prefixes(docs, weights, counts, similarity, n), "prefixes")
    groups = prefix.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("least"), F.max("label").alias("most"), F.bool_or("indexed").alias("any"))
    groups = staged(groups.filter("least <> most and any").select("key", "n"), "groups")
    shared = staged(prefix.join(groups.hint("merge"), "key"), "shared")

    small = shared.filter(F.col("n") <= SMALL)
    x, y = small.alias("x"), small.alias("y")
    lighter = (F.col("x.whole") <= F.col("y.whole")) & F.col("x.indexed") & (F.col("x.whole") >= (similarity - 1e-6) * F.col("y.whole"))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label")) & lighter)
    pairs = pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), F.lit(SMALL).cast("long").alias("n")).distinct()
    links = verify(staged(pairs, "pairs"), docs.select("doc_id", "text"), weights, similarity, n)
    large = shared.filter(F.col("n") > SMALL).select("key", "id", "label", (~F.col("indexed")).alias("inner")).distinct()
    if large.isEmpty():
        return links
    return links.unionByName(_block_links(large, docs.select("doc_id", "text"), weights, similarity, n))


def _block_links(groups: DataFrame, texts: DataFrame, weights, similarity: float = SIMILARITY, n: int = N) -> DataFrame:
    """Links (a, b) that join the classes in each group (key), from all its cross-class pairs.

    groups: key, id, label, inner, and bands where the key is one of them. A group is dealt into
    blocks of bounded size, its inner members apart, which are not compared with one another;
    each two other blocks meet, so that texts move by block and not by pair. With bands, a
    pair is compared in the bucket of its first common band only. Of the links of two blocks only
    those that join two classes are returned.
    """
    texts = texts.withColumnRenamed("doc_id", "id")
    sized = groups.join(texts.select("id", F.length("text").alias("chars")), "id")

    def blocks(inner: bool):
        of = F.when(F.col("inner") == inner, 1)
        return F.ceil(F.greatest(F.count(of) / BLOCK, F.sum(of * F.col("chars").cast("long")) / BLOCK_CHARS)).cast("int")

    counts = staged(sized.groupBy("key").agg(F.greatest(blocks(False), F.lit(1)).alias("others"), F.greatest(blocks(True), F.lit(1)).alias("inners")), "block-counts")
    placed = groups.join(counts.hint("merge"), "key")
    spot = F.xxhash64("id", "key")
    # one block is enough where all fit; else those of the largest class are blocks of their own
    one = (F.col("others") == 1) & (F.col("inners") == 1)
    block = F.when(F.col("inner") & ~one, F.col("others") + F.pmod(spot, F.col("inners"))).otherwise(F.pmod(spot, F.col("others"))).cast("int")
    last = F.when(one, 0).when(F.col("inner"), F.col("others") - 1).otherwise(F.col("others") + F.col("inners") - 1)
    placed = placed.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    kept = [c for c in ("bands",) if c in groups.columns]
    placed = placed.select("key", "id", "label", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), *kept)
    placed = placed.join(texts.hint("merge"), "id")

    def run(group: tuple, table: pa.Table) -> pa.Table:
        return pa.table(_joining(table.sort_by([("block", "ascending"), ("id", "ascending")]), group[0].as_py(), weights.value, similarity, n))

    return placed.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0.0], np.cumsum(values)])[bounds])


def _joining(rows: pa.Table, key: int, table: np.ndarray, similarity: float, n: int) -> dict:
    """Verified links between classes of the one or two blocks in ``rows``, sorted by block."""
    ids, block = (rows.column(c).to_numpy() for c in ("id", "block"))
    _, kind = np.unique(rows.column("label").to_numpy(), return_inverse=True)
    vectors = _vectors(rows.column("text"), table, n) if len(np.unique(kind)) > 1 else []
    bands = np.zeros((len(ids), 0), np.int64)  # those before this one
    if "bands" in rows.column_names:
        bands = np.array(rows.column("bands").to_pylist(), np.int64)
        here = (bands == key).any(axis=0)  # a document of several texts has several lists of bands
        bands = bands[:, : int(here.argmax()) if here.any() else 0]
    out: dict = {"a": [], "b": []}
    if vectors:
        first = int(np.searchsorted(block, block[0], "right"))
        begin = first if first < len(ids) else 0  # the rows to compare with: the second block, or the only one
        _, at = np.unique(np.concatenate([v[0] for v in vectors]), return_inverse=True)
        weight = np.concatenate([v[1] for v in vectors]).astype(float)
        bounds = np.cumsum([0, *(len(v[0]) for v in vectors)])
        whole = _sums(weight, bounds)
        seen = np.zeros(at.max() + 1)
        for i in range(first):
            least = max(begin, i + 1)
            there = slice(least, None)
            wanted = (kind[there] != kind[i]) & ~(bands[there] == bands[i]).any(axis=1)
            wanted &= np.minimum(whole[there], whole[i]) >= (similarity - 1e-6) * np.maximum(whole[there], whole[i])
            if not wanted.any():
                continue
            mine = slice(bounds[i], bounds[i + 1])
            seen[at[mine]] = weight[mine]
            shared = _sums(np.minimum(seen[at[bounds[least] :]], weight[bounds[least] :]), bounds[least:] - bounds[least])
            seen[at[mine]] = 0
            near = wanted & (shared >= (similarity - 1e-6) * (whole[there] + whole[i] - shared))
            for j in (np.flatnonzero(near) + least).tolist():
                if kind[j] != kind[i] and weighted_jaccard(vectors[i], vectors[j]) >= similarity:
                    kind[kind == kind[j]] = kind[i]
                    out["a"].append(min(ids[i], ids[j]))
                    out["b"].append(max(ids[i], ids[j]))
    return {c: pa.array(v, pa.int64()) for c, v in out.items()}


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(id, label) after more links (a, b); only the classes that these join are gone over again."""
    for end in ("a", "b"):
        links = links.join(labels.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label")), end, "left")
    joins = links.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")).filter("a <> b").distinct()
    joins = staged(joins, "joins")
    if joins.isEmpty():
        return labels
    moved = connected(joins)
    old = labels.join(moved.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
    return staged(old.unionByName(moved.join(labels.select("id"), "id", "left_anti")), "labels")


def near_classes(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    n: int = N,
    bands: int = BANDS,
    rows: int = ROWS,
    sketch_bits: int = SKETCH_BITS,
) -> DataFrame:
    """doc_id, class_id for each row of ``docs``.

    A class is a connected component of the verified links; class_id is its least doc_id.
    Weights are term frequency times a factor from 1 (in all documents) to 2 (in one of RARE
    or fewer). All pairs that agree on a band are compared, in buckets of any size, unless
    already of one class or ruled out by the prefix filter. A link is missed only if no band
    agrees: with 14 bands of 4 that is 6 in 10,000 pairs at similarity 0.8 and none to speak of
    from 0.85. Defined cases: a document without a word (null, empty, blanks) is a class of its
    own; one of fewer than ``n`` words is one shingle; a doc_id on several rows is one document
    with all their texts, but a text that a lower doc_id has too goes with that one; a row
    without a doc_id has the class of the documents with its shingles, or none; an empty table
    gives no rows; other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    rows_in = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch, total = frequency_sketch(rows_in, sketch_bits, n)
    weights = spark.sparkContext.broadcast(idf_table(sketch, total))
    signed = staged(signatures(rows_in, weights, bands, rows, n), "signatures")

    heads = signed.filter("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("id"), F.max("bands").alias("bands"))
    heads = staged(heads.filter("id is not null"), "heads")
    banded = heads.select("id", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # never broadcast: a hot bucket's rows are then split, and the buckets are of no bounded size
    members = staged(banded.join(staged(buckets, "buckets").hint("merge"), "key"), "members")

    pairs = staged(_star_pairs(members), "pairs")
    labels = connected(staged(verify(pairs, rows_in, weights, similarity, n), "links"))
    rest = staged(_rest(members, labels), "rest")
    if not rest.isEmpty():
        labels = _merged(labels, staged(_rest_links(rest, heads, rows_in, weights, sketch_bits, similarity, n), "rest-links"))
    classes = heads.select("sig", "id").join(labels, "id", "left").select("sig", F.coalesce("label", "id").alias("class"))
    classes = staged(classes, "classes")
    return signed.select("doc_id", "sig").join(classes, "sig", "left").select("doc_id", F.coalesce("class", "doc_id").alias("class_id"))


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without those near an earlier one: of each class the least id stays.

    Defined cases: as ``near_classes``, but rows that repeat an id are told apart, and of such
    rows in one class one stays; rows without an id are compared too and come last.
    """
    rows, key = row_keys(docs, id_col)
    classes = near_classes(rows, id_col=key, text_col=text_col, **options)
    if key == id_col:
        gone = classes.filter("doc_id <> class_id").select("doc_id")
        return without(rows, staged(gone, "dropped"), key)
    names = rows.select(F.col(key).alias("doc_id"), F.col(id_col).cast("long").alias("name"))
    named = staged(classes.join(names, "doc_id"), "named")
    first = named.groupBy("class_id").agg(F.min(F.struct(F.col("name").isNull(), "name", "doc_id"))["doc_id"].alias("first"))
    gone = named.join(staged(first, "firsts").hint("merge"), "class_id").filter("doc_id <> first").select("doc_id")
    return without(rows, staged(gone, "dropped"), key).drop(key)
