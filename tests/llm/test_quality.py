import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from snapstride.llm import language, mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stats(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_statistics(documents, texts, odd, odd_texts, spark, empty):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    for df, wanted in ((documents, texts), (odd, dict(enumerate(odd_texts)))):
        got = quality.quality(df.repartition(3), labels).collect()
        assert len(got) == len(wanted)
        for r in got:
            s = stats(wanted[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == s, r.doc_id
            failed = s[0] < 10 or 100 * s[4] > 20 * s[0]
            assert r.base_failed == failed and not (failed and r.kept)
    assert quality.quality(empty, labels).count() == 0


def test_verdicts_follow_the_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = quality.quality(docs, labels).filter("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in rows}
    assert kept[1] > 0.99 and kept[0] < 0.2


def test_labels_that_are_absent_or_doubled(documents, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.quality(documents, none).collect()
    assert all(r.kept == (not r.base_failed) for r in rows)
    doubled = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    assert quality.quality(documents, doubled).count() == len(rows)
    kept = quality.keep_good(documents.withColumn("kept", F.lit("clash")), none)
    assert kept.columns == [*documents.columns, "kept"] and kept.count() == sum(r.kept for r in rows)


def test_forest_isolates_what_is_far():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 0.1, (2000, 3)), rng.normal(3, 0.1, (20, 3))])
    forest = quality.Forest.fit(x).calibrate(x, np.arange(2020) < 2000, 0.01)
    score = forest.score(x)
    assert score[2000:].min() > score[:2000].max() and (score[2000:] > forest.threshold).all()


def iterated_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        per = left / sum(w[s] for s in open_)
        full = [s for s in open_ if per * w[s] > most * sizes[s]]
        for s in full or open_:
            target[s] = most * sizes[s] if full else per * w[s]
        if not full:
            break
        left -= sum(target[s] for s in full)
        open_ -= set(full)
    return target


def test_mix_meets_its_targets(documents, odd, odd_texts, empty, spark):
    mixed = odd.withColumn("source", F.when(F.col("doc_id") % 4 == 0, None).otherwise((F.col("doc_id") % 4).cast("string")))
    for df in (documents, mixed):
        rows = mixing.plan_mix(df.repartition(3)).collect()
        sizes, taken, largest = Counter(), Counter(), Counter()
        for r in rows:
            sizes[r.source] += r.size
            taken[r.source] += r.taken
            largest[r.source] = max(largest[r.source], r.size)
            assert r.taken == r.size * r.copies <= 2 * r.size
        want = iterated_targets(sizes)
        for r in rows:
            assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-3
            assert abs(taken[r.source] - r.target) <= largest[r.source] / 2 + 1e-3
            assert r.copies >= r.target // max(1, r.source_size)  # whole epochs first
        assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.plan_mix(df).collect()), key=str)
    assert mixing.plan_mix(empty).count() == 0


def test_mix_prefers_weight(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.lit("s").alias("source"))
    got = mixing.plan_mix(rows, quality=F.when(F.col("doc_id") < 2000, 4.0).otherwise(1.0), share=0.5).collect()
    first = sum(r.copies for r in got if r.doc_id < 2000)
    assert sum(r.copies for r in got) == 2000 and 1400 < first < 1900


def test_language_of_held_out(documents, texts):
    rows = {r.doc_id: r for r in language.identify(documents.repartition(3)).collect()}
    langs = {r.doc_id: r.lang for r in documents.collect()}
    assert {d for d, r in rows.items() if r.held_out} == {d for d in texts if language.fold_of(d) == 0}
    held = [d for d, r in rows.items() if r.held_out]
    assert np.mean([rows[d].lang_pred == langs[d] for d in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_language_defined_cases(odd, odd_texts, empty, spark):
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(odd).collect()}
    assert all(got[i] == ("und", 0.0) for i in (0, 1, 2, 3)) and got[13][0] == "en"
    assert language.identify(empty).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}


def test_prediction_does_not_see_the_label(documents):
    swapped = documents.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    a, b = ({(r.doc_id, r.lang_pred, r.score) for r in language.identify(d).collect()} for d in (documents, swapped))
    assert a == b


def naive_language(docs, share=0.5, least=3, n=4, bits=18):
    """The same filters from dictionaries, n-gram by n-gram; docs: (id, text, lang)."""
    def grams(text):
        raw = re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode())
        return [int.from_bytes(raw[i : i + n], "little") for i in range(len(raw) - n + 1)]

    def places(g):
        return [((g * m) % (1 << 64)) >> (64 - bits) for m in language._MULTIPLIERS]

    counts, totals = [Counter(), Counter()], Counter()
    for d, text, lang in docs:
        if text is not None and lang is not None and language.fold_of(d):
            for g in grams(text):
                totals[lang] += 1
                for k, p in enumerate(places(g)):
                    counts[k][lang, p] += 1
    langs = sorted({x for _, t, x in docs if x is not None} & ({*totals} | {x for d, t, x in docs if t is not None and language.fold_of(d)}))
    best = [Counter(), Counter()]
    for k in (0, 1):
        for (lang, p), c in counts[k].items():
            best[k][p] = max(best[k][p], c / totals[lang])
    members = [{(lang, p) for (lang, p), c in counts[k].items() if c >= least and c / totals[lang] >= share * best[k][p]} for k in (0, 1)]
    chance = {x: np.prod([sum(lang == x for lang, _ in members[k]) / (1 << bits) for k in (0, 1)]) for x in langs}
    out = {}
    for d, text, _ in docs:
        if not text or not any(c.isalpha() for c in text) or not langs:
            out[d] = ("und", 0.0)
            continue
        own = [places(g) for g in grams(text)]
        right = [max(sum((x, a) in members[0] and (x, b) in members[1] for a, b in own) - len(own) * chance[x], 0) / (1 - chance[x]) for x in langs]
        i = int(np.argmax(right))
        out[d] = (langs[i], right[i] / sum(right) if sum(right) else 0.0)
    return out


def test_predictions_are_those_of_brute_force(spark, documents):
    rows = [(r.doc_id, r.text, r.lang) for r in documents.select("doc_id", "text", "lang").collect() if len(r.text or "") < 800][:150]
    rows += [(10**6, None, "en"), (10**6 + 1, "12 34", "de"), (10**6 + 2, "ab", None), (10**6 + 3, "\u6f22\u5b57\u6f22\u5b57", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    want = naive_language(rows)
    for r in language.identify(df).collect():
        assert r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-9, r


def test_more_languages_than_a_word_has_bits(spark):
    rng = np.random.default_rng(3)
    letters = [[chr(0x4E00 + 40 * i + j) for j in range(20)] for i in range(90)]
    rows = [(k, "".join(rng.choice(letters[k % 90], 60)), f"l{k % 90:02d}") for k in range(1800)]
    rows += [(10**6, letters[3][0] + "?", "l03")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(df).collect()}
    assert np.mean([got[d].lang_pred == x for d, _, x in rows if got[d].held_out]) > 0.95
    same = spark.createDataFrame([(k, "one and the same text", x) for k, x in enumerate(["b", "a", "c"] * 20)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify(same).collect()} == {"a"}  # a tie


def naive_score(forest, row):
    """Path by path, node by node."""
    total = 0.0
    for column, value, length in zip(forest.column, forest.value, forest.length):
        node = 0
        while column[node] >= 0:
            node = 2 * node + (1 if row[column[node]] < value[node] else 2)
        total += length[node]
    n = forest.rows
    expected = 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else float(n == 2)
    return 2 ** -(total / len(forest.column) / max(1e-9, expected))


def test_verdicts_are_those_of_brute_force(documents, texts, spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = documents.select("doc_id", "text")
    forest = quality.fit_forest(rows, labels)
    got = {r.doc_id: r for r in quality.quality(documents, labels).collect()}
    for d in sorted(texts)[::7]:
        text = texts[d] or ""
        n_words, word_chars, n_symbols, _, n_repeat = stats(text)
        words = WORD.findall(text)
        marks, upper = sum(c in "!?" for c in text), sum("A" <= c <= "Z" for c in text)
        doubled = sum(a == b for a, b in zip(words, words[1:]))
        w, c = n_words + quality.PRIOR_WORDS, word_chars + quality.PRIOR_WORDS * quality.PRIOR_CHARS
        row = [x / (x + h) for x, h in ((n_symbols / w, 0.1), (marks / w, 0.1), (upper / c, 0.1), (doubled / w, 0.1), (c / w, 10.0))]
        score = naive_score(forest, row)
        assert abs(got[d].score - score) < 1e-9
        assert got[d].kept == (not (n_words < 10 or 100 * n_repeat > 20 * n_words) and score <= forest.threshold)


def test_reruns_agree_where_labelled_ids_repeat(documents, spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    again = documents.unionByName(documents.withColumn("text", F.concat("text", F.lit(" ### !! ##")))).select("doc_id", "text")
    a, b = (quality.fit_forest(x, labels) for x in (again.repartition(3), again.repartition(7)))
    assert (a.value == b.value).all() and a.threshold == b.threshold


def test_held_out_labels_agree(spark):
    """Fitted on four fifths of the labels, judged on the last."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(5))
    rows = quality.quality(docs, labels.filter(fold != 0)).filter("not base_failed").join(labels.filter(fold == 0), "doc_id")
    kept = {r.quality: r.kept for r in rows.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    print("held out", kept)
    assert kept[1] > 0.98 and kept[0] < 0.2


def test_threshold_and_draws_are_those_of_all_labelled_rows(spark, monkeypatch):
    rng = np.random.default_rng(12)
    n = 30_000
    x = rng.random((n, 5)).round(6)
    good = rng.random(n) > 0.1
    rows = spark.createDataFrame([(i, bool(g), v) for i, (g, v) in enumerate(zip(good, x.tolist()))], "doc_id long, good boolean, x array<double>")
    monkeypatch.setattr(quality, "_labelled", lambda docs, labels: rows)
    forest = quality.fit_forest(rows, rows, trees=20, tree_rows=64, false_rejects=0.1)
    whole = quality.Forest(forest.column, forest.value, forest.length, forest.rows).calibrate(x, good, 0.1)
    assert abs(forest.threshold - whole.threshold) < 1e-12
    draws = quality._draws(rows, int(good.sum()), int((~good).sum()), 20, 64)
    assert all(len(d) == 64 for d in draws) and len(np.unique(np.concatenate(draws), axis=0)) > 1200
