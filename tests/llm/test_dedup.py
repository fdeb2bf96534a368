import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from snapstride.llm import exact_dedup, idfilter, line_dedup, near_dedup, words
from snapstride.llm.components import connected

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(LOWER)].append(d)
    return {(d, max(g), len(g), d == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g}


def test_exact_groups(odd, odd_texts, empty):
    got = exact_dedup.exact_dedup(odd)
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()} == exact(enumerate(odd_texts))
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_colliding_identifiers_are_passed_over(odd, odd_texts):
    weak = (lambda c: F.pmod(F.length(c), F.lit(3)).cast("long"), lambda c: F.xxhash64(c))
    folded = odd.select("doc_id", exact_dedup.fold_ascii(F.col("text")).alias("text"))
    assert not exact_dedup.injective(folded, weak[0]) and exact_dedup.injective(folded, weak[1])
    got = exact_dedup.exact_dedup(odd, identifiers=weak).collect()
    assert {(r.doc_id, r.keep_id) for r in got} == {x[:2] for x in exact(enumerate(odd_texts))}


def test_chunks_join_to_the_text_and_resynchronise(spark, odd_texts, texts):
    long = "\n".join(texts.values()).translate(LOWER)[:300_000]
    df = spark.createDataFrame([(long,), ("inserted words at the front " + long,), (odd_texts[11],)], "text string")
    a, b, c = (r.c for r in df.select(exact_dedup.chunks(F.col("text")).alias("c")).collect())
    assert "".join(a) == long and "".join(c) == odd_texts[11] and max(map(len, a + b + c)) <= 4096
    assert 300 < 300_000 / len(a) < 1000 and len(set(a) & set(b)) > 0.9 * len(set(a))


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a"), (5, "A"), (5, "a"), (None, "z")], "doc_id long, text string")
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect())
    assert got == Counter({(None, 5, 3, False): 1, (5, 5, 3, True): 2, (None, None, 1, True): 1})


def line_brute(rows, least=5):
    def key(x):
        x = x.strip(" \t\n\x0b\x0c\r")
        return x.translate(LOWER) if len(x) >= 40 else None

    holders = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if key(x):
                holders[key(x)].add(d)
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and len(holders[key(x)]) >= least and d != max(holders[key(x)]))]
        out[d] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def test_lines(odd, odd_texts, documents, texts, empty):
    for df, rows, most in ((odd, list(enumerate(odd_texts)), 28), (documents, list(texts.items()), 28), (documents, list(texts.items()), 8), (odd, list(enumerate(odd_texts)), 8)):
        got = line_dedup.line_dedup(df.repartition(5), most_bits=most)  # filters that stay where they are give the same rows
        assert got.columns[-2:] == ["n_lines", "n_dropped"]
        assert {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in got.collect()} == line_brute(rows)
    for most in (28, 8):
        assert line_dedup.line_dedup(empty, most_bits=most).count() == 0
    kept = line_dedup.line_dedup(odd)
    assert set(kept.columns) == set(odd.columns) | {"n_dropped"} and kept.first().recipe == "clash"


def test_lines_of_documents_without_an_id_stay(spark):
    line = "A line that is well over forty code points long, it is."
    rows = [(i, line) for i in range(4)] + [(None, f"{line}\nown")] * 3
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.n_dropped for r in got.collect()} == {0}  # four documents, not five
    got = line_dedup.line_dedup(spark.createDataFrame([*rows, (9, line)], "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_dropped) for r in got) == Counter({**{(i, 1): 1 for i in range(4)}, (9, 0): 1, (None, 0): 3})


def test_merged_filters_lose_no_repeat(spark):
    rng = np.random.default_rng(0)
    parts = [words.mix(rng.integers(0, 4000, 900).astype(np.uint64)) for _ in range(6)]
    rows = []
    for p in parts:
        found, counts = np.unique(p, return_counts=True)
        rows.append((len(found), bytearray(found.tobytes()), bytearray(found[counts > 1].tobytes())))
    size = line_dedup.Size.of(sum(r[0] for r in rows))
    table = np.zeros(1 << size.bits, bool)
    for k, raw in line_dedup.twice_seen(spark.createDataFrame(rows, line_dedup.PARTS).repartition(3), size).collect():
        table[k << size.inner : (k + 1) << size.inner] = np.unpackbits(np.frombuffer(raw, np.uint8))
    every, counts = np.unique(np.concatenate(parts), return_counts=True)
    hit = table[(size.range_of(every) << size.inner)[:, None] + size.places(every)].all(axis=1)
    assert hit[counts > 1].all() and hit[counts == 1].mean() < 0.05


def test_the_filter_is_as_sharp_at_any_size():
    rng = np.random.default_rng(1)
    for lines in (1_000_000, 80_000_000, 3_000_000_000_000):
        size = line_dedup.Size.of(lines)
        assert lines * 12 <= 1 << size.bits <= lines * 24 and size.inner <= 22
        # one range's share, all of them lines of one document, in 40 parts
        share = lines >> size.ranges
        own = rng.integers(0, 1 << 64, share, dtype=np.uint64)
        seen = line_dedup.Seen(size)
        for part in np.array_split(own, 40):
            seen.add(part, part[:0])
        assert seen.twice[size.places(own)].all(axis=1).mean() < 0.05


def brute_classes(texts: dict, similarity=0.8):
    """Components of all links by weighted Jaccard over five-word shingles."""
    ids = list(texts)
    vectors, sketch = {}, np.zeros(1 << 20, np.int64)
    for first, keys, counts, bounds in near_dedup.doc_shingles(pa.array(list(texts.values()), pa.string())):
        sketch += np.bincount((keys & np.uint64((1 << 20) - 1)).astype(np.int64), minlength=1 << 20)
        for i in range(len(bounds) - 1):
            vectors[ids[first + i]] = (keys[bounds[i] : bounds[i + 1]], counts[bounds[i] : bounds[i + 1]])
    table = near_dedup.idf_table(sketch, len(ids))
    vectors = {d: (k, table[(k & np.uint64((1 << 20) - 1)).astype(np.int64)] * c.astype(np.float32)) for d, (k, c) in vectors.items()}
    holders = defaultdict(list)
    for d, (keys, _) in vectors.items():
        for k in keys.tolist():
            holders[k].append(d)
    shared = Counter((a, b) for own in holders.values() for i, a in enumerate(own) for b in own[i + 1 :])
    label = {d: d for d in ids}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    links = [(a, b) for a, b in shared if near_dedup.weighted_jaccard(vectors[a], vectors[b]) >= similarity]
    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {d: find(d) for d in ids}, links


def test_near_classes_are_those_of_brute_force(documents, texts):
    wanted, links = brute_classes(texts)
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(documents.repartition(4)).collect()}
    assert len(links) > 50 and got == wanted


def test_a_large_group_of_near_copies_is_one_class(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 5000, 400)]
    rows = []
    for d in range(150):
        text = list(base)
        for at in rng.integers(0, 400, 3):
            text[at] = f"e{d}x{at}"
        rows.append((d, " ".join(text)))
    rows += [(1000 + d, " ".join(f"z{x}" for x in rng.integers(0, 10**6, 300))) for d in range(60)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all(got[d] == 0 for d in range(150)) and all(got[d] == d for d in got if d >= 1000)


def test_copies_that_are_near_their_base_only_are_one_class(spark):
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in rng.permutation(5000)[:600]]
    texts = {}
    for d in range(500):  # each like the base, few like each other; the base is not the least id
        text = list(base)
        for at in rng.choice(np.arange(5, 595), 7, replace=False) if d != 250 else []:
            text[at] = f"e{d}x{at}"
        texts[d] = " ".join(text)
    some, links = brute_classes({d: texts[d] for d in range(240, 261)})
    assert set(some.values()) == {240} and sum(250 in x for x in links) == 20 and len(links) < 30
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)).collect()}
    assert set(got.values()) == {0}


def _templated(documents=240, template=400, own=36):
    """Documents of one template, each with words of its own, in pairs that share 12 or 16 of these."""
    frame = " ".join(f"t{i}" for i in range(template))
    texts = {}
    for pair in range(documents // 2):
        shared = 12 if pair % 2 else 16
        for k in (0, 1):
            texts[2 * pair + k] = f"{frame} " + " ".join(f"p{pair}w{i}" if i < shared else f"p{pair}w{i}x{k}" for i in range(own))
    return texts


@pytest.mark.parametrize("vast", [16, 1024])
def test_no_pair_of_a_template_is_lost(spark, monkeypatch, vast):
    monkeypatch.setattr(near_dedup, "VAST", vast)  # by the prefix filter, and block by block
    texts = _templated()
    wanted, links = brute_classes(texts)
    assert len(links) == 120  # the pairs and no others
    found = near_dedup.near_classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4))
    assert {r.doc_id: r.class_id for r in found.collect()} == wanted


def test_prefixes_of_similar_documents_meet(documents, texts):
    """Every similar pair shares a shingle in both prefixes, the lighter document's the short one."""
    sample = {**{d: t for d, t in texts.items() if t and len(t) < 4000}, **{10**6 + d: t for d, t in _templated(60).items()}}
    _, links = brute_classes(sample)
    table = pa.table({"doc_id": list(sample), "label": list(sample), "text": list(sample.values())})
    sketch = np.zeros(1 << 20, np.int64)
    for _, keys, _, _ in near_dedup.doc_shingles(table.column("text").combine_chunks()):
        sketch += np.bincount((keys & np.uint64((1 << 20) - 1)).astype(np.int64), minlength=1 << 20)

    spark = documents.sparkSession
    weights, counts = (spark.sparkContext.broadcast(x) for x in (near_dedup.idf_table(sketch, len(sample)), sketch))
    rows = near_dedup.prefixes(spark.createDataFrame(table.to_pandas()).repartition(4), weights, counts).collect()
    whole, probe, index = {r.id: r.whole for r in rows}, defaultdict(set), defaultdict(set)
    for r in rows:
        probe[r.id].add(r.key)
        if r.indexed:
            index[r.id].add(r.key)
    assert len(links) > 50
    for a, b in links:
        light, heavy = sorted((a, b), key=lambda d: whole[d])
        assert index[light] & probe[heavy]


def test_weights_depend_on_shares_not_on_size():
    rng = np.random.default_rng(0)
    for docs in (20_000, 20_000_000):
        sketch = rng.poisson(docs * 300 / (1 << 20), 1 << 20)
        sketch[:3] += [1, docs // 100, docs]
        table = near_dedup.idf_table(sketch, docs)
        assert table[0] > 1.9 and abs(table[1] - 1.664) < 0.02 and table[2] < 1.01


def test_near_odd(odd, odd_texts, empty, spark):
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(odd).collect()}
    assert set(got) == set(range(len(odd_texts)))
    assert got[15] == got[13] == got[14]  # A-Z count as a-z
    assert all(got[i] == i for i in (0, 1, 2, 3))  # without a word
    assert near_dedup.near_classes(empty).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "x y z u v w"), (None, "a b c d e f")], "doc_id long, text string")
    assert Counter(r.doc_id for r in near_dedup.near_classes(twice).collect()) == Counter({1: 2, None: 1})
    a, b = (" ".join(f"{k}{i}" for i in range(80)) for k in "ab")
    linked = spark.createDataFrame([(1, a), (1, b), (2, f"{a} x"), (3, f"{b} x"), (4, "a b c")], "doc_id long, text string")
    assert {(r.doc_id, r.class_id) for r in near_dedup.near_classes(linked).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_sampling_agrees_as_often_as_texts_are_similar():
    rng = np.random.default_rng(5)
    keys = np.sort(rng.integers(0, 1 << 48, 1200, dtype=np.uint64))
    weights = rng.uniform(1, 4, 1200).astype(np.float32)
    a, b = np.r_[0:1000], np.r_[200:1200]
    both = np.concatenate([keys[a], keys[b]])
    scale = np.concatenate([weights[a], weights[b] * np.where(rng.random(1000) < 0.5, 1, 1.3).astype(np.float32)])
    drawn = near_dedup.Sampler(3000).samples(both, scale, np.array([0, 1000, 2000]))
    true = near_dedup.weighted_jaccard((both[:1000], scale[:1000]), (both[1000:], scale[1000:]))
    assert abs((drawn[0] == drawn[1]).mean() - true) < 0.04


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(300, 301)]
    got = {r.id: r.label for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, 300: 300, 301: 300}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hubs_are_salted(spark, monkeypatch):
    from snapstride.llm import components

    monkeypatch.setattr(components, "HUB", 20)
    links = [(500, i) for i in range(1, 200)] + [(i, i + 1) for i in range(600, 640)] + [(640, 3)]
    got = {r.id: r.label for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(got.values()) == {1} and len(got) == 241


def test_id_filter_parts_rows_without_loss(spark):
    rows = spark.range(2000).select("id", F.lit("x").alias("v")).unionByName(spark.createDataFrame([(None, "n")], "id long, v string"))
    ids = spark.range(0, 2000, 3)
    assert {r.id for r in idfilter.without(rows, ids, "id").collect()} == {None, *(i for i in range(2000) if i % 3)}
    assert idfilter.without(rows, ids.limit(0), "id").count() == 2001


def test_id_filters_are_sized_by_their_ids():
    rng = np.random.default_rng(2)
    for n in (1000, 200_000):
        bits = idfilter.bits_for(n)
        table = np.zeros(1 << bits, bool)
        table[idfilter._places(np.arange(n), bits)] = True
        others = rng.integers(n, 1 << 60, 50_000)
        assert idfilter.bit_at(np.packbits(table), idfilter._places(np.arange(n), bits)).all()
        assert idfilter.bit_at(np.packbits(table), idfilter._places(others, bits)).all(axis=1).mean() < 0.03
    assert idfilter.bits_for(0) == 16 and idfilter.bits_for(10**12) == idfilter.MOST_BITS


def test_word_and_shingle_hashes():
    column = pa.array(["a bb  a", None, "", "bb", "x y z u v w x y z u v", "\t\n"])
    for part in (column, column.slice(1, 4)):
        data, offs = words.text_bytes(part)
        found = words.find_words(data, offs)
        lists = [(t or "").split() for t in part.to_pylist()]
        assert found.counts.tolist() == [len(x) for x in lists]
        flat = [w for x in lists for w in x]
        h = found.hashes()
        assert len(set(h.tolist())) == len(set(flat)) and all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))
        s, at = words.shingles(h, found.firsts, 5)
        assert np.diff(at).tolist() == [len(x) - 4 if len(x) >= 5 else int(bool(x)) for x in lists]
