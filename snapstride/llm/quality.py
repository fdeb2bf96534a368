"""Quality rules: an isolation forest over rule statistics.

Each text gives rule statistics (words, symbols, repeated lines and words, letter case,
exclamation). Two fixed rules reject at once. For the rest, random trees split labelled
documents, almost all of them good, on random statistics at random values; as in any
isolation forest a tree splits few rows, its own draw from all labelled ones. A document that
they isolate after few splits is anomalous. The score from which a document is rejected is
calibrated on all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import bounded
from .idfilter import id_filter, may_hold
from .scratch import staged
from .words import BLANK, doc_sums, find_words, mix, plain, shingles, slices, text_bytes

WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent of words
SYMBOLS = b"#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

PRIOR_WORDS, PRIOR_CHARS = 40, 5
TREES = 200
TREE_ROWS = 256
#: Bad rows for each good one in what the trees split, so that bad values stay rare.
BAD_SHARE = 0.05
#: Of the labelled good rows, the share that the threshold may reject.
FALSE_REJECTS = 0.002

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_upper", "n_marks", "n_doubled"]


def _class_table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_SYMBOL = _class_table(SYMBOLS)
_UPPER = _class_table(bytes(range(65, 91)))
_MARK = _class_table(b"!?")
_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True


def repeated_words(hashes: np.ndarray, firsts: np.ndarray, n: int = WINDOW) -> np.ndarray:
    """Words of each document in runs of ``n`` words that the document has twice or more."""
    out = np.zeros(len(firsts) - 1, np.int64)
    for i, j in slices(firsts, 200_000):
        own = firsts[i : j + 1] - firsts[i]
        runs, offs = shingles(hashes[firsts[i] : firsts[j]], own, n)
        doc = np.repeat(np.arange(j - i), np.diff(offs))
        order = np.lexsort((runs, doc))
        same = (runs[order][1:] == runs[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        again = np.zeros(len(runs), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        begin = own[:-1][doc] + np.arange(len(runs)) - offs[:-1][doc]
        inside = np.zeros(own[-1], bool)
        for k in range(n):
            inside[begin[again] + k] = True
        out[i:j] = doc_sums(inside, own)
    return out


def rule_statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of each text, over its whole length; null has none of anything."""
    column = plain(column)
    data, offs = text_bytes(column)
    words = find_words(data, offs)
    hashes = words.hashes()
    doubled = np.zeros(len(hashes), bool)
    doubled[1:] = hashes[1:] == hashes[:-1]
    doubled[words.firsts[:-1][words.counts > 0]] = False
    blank = BLANK[data]
    dups = np.zeros(len(column), np.int64)
    for i, text in enumerate(column.to_pylist()):
        if text:
            own = [x for x in text.split("\n") if x.strip(BLANKS)]
            dups[i] = len(own) - len(set(own))
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": doc_sums(~blank & ~_CONTINUES[data], offs),
        "n_symbols": doc_sums(_SYMBOL[data], offs),
        "n_dup_lines": dups,
        "n_repeat_words": repeated_words(hashes, words.firsts),
        "n_upper": doc_sums(_UPPER[data], offs),
        "n_marks": doc_sums(_MARK[data], offs),
        "n_doubled": doc_sums(doubled, words.firsts),
    }


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    return (stats["n_words"] < LEAST_WORDS) | (100 * stats["n_repeat_words"] > MOST_REPEATED * stats["n_words"])


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Rates that do not grow with a text's length, one row per document.

    A rate x is taken over the text and PRIOR_WORDS words of plain prose, so that few words
    say little, and becomes x / (x + h) for an h that is high for prose, so that a random
    split falls between usual and unusual values however far out the latter are. Repetition
    is left to the base rule: sound texts with a repeated heading are as unusual in it as
    texts that are nothing else.
    """
    words = stats["n_words"] + PRIOR_WORDS
    chars = stats["word_chars"] + PRIOR_WORDS * PRIOR_CHARS
    rates = [(stats["n_symbols"] / words, 0.1), (stats["n_marks"] / words, 0.1), (stats["n_upper"] / chars, 0.1), (stats["n_doubled"] / words, 0.1), (chars / words, 10.0)]
    return np.stack([x / (x + h) for x, h in rates], axis=1)


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Expected path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), (n == 2) * 1.0)


@dataclass
class Forest:
    """Trees as arrays (tree, node): split column (-1: leaf), value, path length at a leaf."""

    column: np.ndarray
    value: np.ndarray
    length: np.ndarray
    rows: int
    threshold: float = np.inf

    @classmethod
    def fit(cls, x: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 11) -> "Forest":
        rng = np.random.default_rng(seed)
        rows = min(tree_rows, len(x))
        return cls.grow([x[rng.choice(len(x), rows, replace=False)] for _ in range(trees)], rows, seed)

    @classmethod
    def grow(cls, samples: list[np.ndarray], rows: int, seed: int = 11) -> "Forest":
        """One tree for each sample of ``rows`` rows."""
        rng, trees = np.random.default_rng(seed), len(samples)
        depth = max(1, int(np.ceil(np.log2(max(2, rows)))))
        nodes = 2 ** (depth + 1) - 1
        column, value, length = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
        for t in range(trees):
            todo = [(0, 0, samples[t])]
            while todo:
                node, level, part = todo.pop()
                low, high = part.min(axis=0), part.max(axis=0)
                open_columns = np.flatnonzero(high > low)
                if level == depth or len(part) <= 1 or not len(open_columns):
                    length[t, node] = level + _mean_path(len(part))
                    continue
                c = int(rng.choice(open_columns))
                v = float(rng.uniform(low[c], high[c]))
                column[t, node], value[t, node] = c, v
                left = part[:, c] < v
                todo += [(2 * node + 1, level + 1, part[left]), (2 * node + 2, level + 1, part[~left])]
        return cls(column, value, length, rows)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): near 1 for anomalous rows, below 0.5 for usual ones."""
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for column, value, length in zip(self.column, self.value, self.length, strict=True):
            node = np.zeros(len(x), np.int64)
            while True:
                c = column[node]
                inner = c >= 0
                if not inner.any():
                    break
                right = x[every, np.maximum(c, 0)] >= value[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += length[node]
        return 2.0 ** -(total / len(self.column) / max(1e-9, float(_mean_path(self.rows))))

    def calibrate(self, x: np.ndarray, good: np.ndarray, false_rejects: float = FALSE_REJECTS) -> "Forest":
        """Sets the score above which a row is rejected.

        Among scores that reject at most ``false_rejects`` of the good rows, the one midway
        between the last good row it keeps and the next bad one; without both kinds, none.
        """
        score = self.score(x)
        if not good.any() or good.all():
            return self
        keep = np.sort(score[good])
        most = keep[min(len(keep) - 1, int(np.ceil((1 - false_rejects) * len(keep))))]
        above = score[~good & (score > most)]
        self.threshold = float((most + above.min()) / 2) if len(above) else float(most)
        return self


N_FEATURES = 5


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, good and features x of all labelled documents that pass the base rules, written once."""
    some = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter("doc_id is not null and quality is not null")
    some = some.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    packed = docs.sparkSession.sparkContext.broadcast(id_filter(some.select("doc_id")))
    names = [*BASE, *MORE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(iter([batch.filter(pa.array(may_hold(packed.value, batch.column("doc_id"))))])):
                stats = rule_statistics(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(stats[n]) for n in names]], names=["doc_id", *names])

    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = {n: batch.column(n).to_numpy() for n in names}
            x = pa.FixedSizeListArray.from_arrays(pa.array(features(stats).ravel()), N_FEATURES).cast(pa.list_(pa.float64()))
            found = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(batch.column("quality").to_numpy() == 1), x], names=["doc_id", "good", "x"])
            yield found.filter(pa.array(~base_failed(stats)))

    found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names)).join(some, "doc_id")
    # of the rows of a repeated doc_id the least, so that reruns agree
    least = found.groupBy("doc_id").agg(F.min(F.struct("quality", *names)).alias("row")).select("doc_id", "row.*")
    return staged(least.mapInArrow(rates, "doc_id long, good boolean, x array<double>"), "labelled")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, N_FEATURES)


def _draws(rows: DataFrame, good: int, bad: int, trees: int, tree_rows: int) -> list[np.ndarray]:
    """For each tree ``tree_rows`` of all rows, those with the least hashes of id and tree.

    A bad row's hash counts as more, so that BAD_SHARE of what trees split is bad. Only rows
    whose hash may be among the least, about twice as many, reach the driver.
    """
    few = max(1, int(BAD_SHARE * good))
    share = min(1.0, few / max(1, bad))
    rate = 2 * tree_rows / (good + share * bad)
    salts = mix(np.arange(1, trees + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                ids = mix(part.column("doc_id").to_numpy().astype(np.int64).view(np.uint64))
                key = (mix(ids[:, None] ^ salts[None, :]) >> np.uint64(11)) * 2.0**-53
                key /= np.where(part.column("good").to_numpy(zero_copy_only=False), 1.0, share)[:, None]
                row, tree = np.nonzero(key < rate)
                yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(key[row, tree]), part.column("x").take(pa.array(row))], names=["tree", "key", "x"])

    found = rows.mapInArrow(run, "tree long, key double, x array<double>").toArrow().combine_chunks()
    tree, key, x = found["tree"].to_numpy(), found["key"].to_numpy(), _matrix(pa.concat_arrays(found["x"].chunks)) if len(found) else np.zeros((0, N_FEATURES))
    order = np.lexsort((*x.T, key, tree))
    cuts = np.searchsorted(tree[order], np.arange(trees + 1))
    return [x[order[i:j]][:tree_rows] for i, j in zip(cuts, cuts[1:])]


def fit_forest(docs: DataFrame, labels: DataFrame, *, trees: int = TREES, tree_rows: int = TREE_ROWS, false_rejects: float = FALSE_REJECTS) -> Forest | None:
    """Forest and threshold from all labelled documents; None without a good one.

    docs: doc_id, text; labels: doc_id, quality (0 or 1). The threshold is that of
    ``Forest.calibrate`` on all labelled rows. The trees' rows are all that reaches the driver.
    """
    rows = _labelled(docs, labels)
    good, bad = rows.agg(F.count_if("good"), F.count_if(~F.col("good"))).first()
    if not good:
        return None
    samples = _draws(rows, good, bad, trees, tree_rows)
    forest = Forest.grow(samples, max(1, int(np.median([len(x) for x in samples]))))
    if not bad:
        return forest
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(shared.value.score(_matrix(batch.column("x"))))], names=["good", "score"])

    scored = staged(rows.select("good", "x").mapInArrow(score, "good boolean, score double"), "label-scores")
    above = good - min(good - 1, int(np.ceil((1 - false_rejects) * good)))  # good rows from the last one kept
    most = scored.filter("good").select("score").orderBy(F.col("score").desc()).limit(above).agg(F.min("score")).first()[0]
    nearest = scored.filter((~F.col("good")) & (F.col("score") > most)).agg(F.min("score")).first()[0]
    forest.threshold = float(most if nearest is None else (most + nearest) / 2)
    return forest


def _verdicts(forest: Forest | None, stats: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, score, kept."""
    failed = base_failed(stats)
    score = forest.score(features(stats)) if forest else np.zeros(len(failed))
    return failed, score, ~failed & (score <= (forest.threshold if forest else np.inf))


def quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and score for each row of ``docs``.

    Defined cases: a null or empty text has no words and fails the base rules; without good
    labelled rows only the base rules decide, and without bad ones no score is rejected;
    repeated rows are judged one by one; a doc_id labelled twice counts as its lower label, and
    one that stands on several rows is fitted by the row of least statistics; an empty table
    gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit_forest(rows, labels, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            stats = rule_statistics(batch.column("text"))
            failed, score, kept = _verdicts(model.value, stats)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(stats[n]) for n in BASE], pa.array(failed), pa.array(kept), pa.array(score)], names=["doc_id", *BASE, "base_failed", "kept", "score"])

    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in BASE) + ", base_failed boolean, kept boolean, score double")


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, all columns, in one pass without a shuffle."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit_forest(rows, labels, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, text_col):
            kept = _verdicts(model.value, rule_statistics(batch.column(text_col)))[2]
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
