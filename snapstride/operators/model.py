"""Grouped-softmax models: gradient, folds, bootstrap, linear and tree learners, ensembles.

Fits are independent by (fold, replicate), so each is one task, its randomness seeded from its
key. A resample draws whole groups, so a fit gets each group it draws once, with how often it was
drawn: a linear fit as blocks of plain numbers, a tree fit as counts of the rows that fall in the
same bins, which score alike.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir

HESSIAN_FLOOR = 1e-3
#: The most that an Arrow batch of blocks holds.
BATCH_BYTES = 8 << 20
#: Partitions for each fit, so that hardly any two fits meet in one.
SPREAD = 8
#: Parts of a column in which the wanted ranks of a quantile are looked for.
PARTS = 256


def seed_of(*key) -> int:
    return zlib.crc32("|".join(map(str, key)).encode())


def group_softmax(score: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Softmax within groups of equal codes (0..n-1, in any order)."""
    if not codes.any():
        e = np.exp(score - score.max())
        return e / e.sum()
    top = np.full(codes.max() + 1, -np.inf)
    np.maximum.at(top, codes, score)
    e = np.exp(score - top[codes])
    return e / np.bincount(codes, e)[codes]


def pl_gradient(score: np.ndarray, codes: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient p - y and floored diagonal p (1 - p) of the grouped cross-entropy."""
    p = group_softmax(score, codes)
    return p - label, np.maximum(p * (1 - p), HESSIAN_FLOOR)


def grouped_loss(score: np.ndarray, codes: np.ndarray, label: np.ndarray) -> float:
    return float(-(label * np.log(np.clip(group_softmax(score, codes), 1e-300, 1))).sum())


Part = tuple[np.ndarray, np.ndarray, int]


def parts_of(x: np.ndarray, codes: np.ndarray, label: np.ndarray) -> list[Part]:
    """Rows, labels and weight 1 of each group of equal codes (0..n-1, in any order)."""
    order = np.argsort(codes, kind="stable")
    cuts = np.flatnonzero(np.diff(codes[order])) + 1
    return [(x[rows], label[rows], 1) for rows in np.split(order, cuts)]


def fit_linear(x: np.ndarray, codes: np.ndarray, label: np.ndarray, **options) -> np.ndarray:
    return fit_linear_parts(parts_of(x, codes, label), **options)


def fit_linear_parts(parts: list[Part], rounds: int = 60, ridge: float = 1.0, signs: np.ndarray | None = None) -> np.ndarray:
    """Weights by damped diagonal Newton steps over groups (rows, labels, how often each counts).

    ``signs`` clips weights to -1 (<= 0) or +1 (>= 0).
    """
    one = [np.zeros(len(x), int) for x, _, _ in parts]

    def penalised(w):
        return sum(times * grouped_loss(x @ w, code, y) for (x, y, times), code in zip(parts, one, strict=True)) + ridge * w @ w / 2

    w = np.zeros(parts[0][0].shape[1])
    loss = penalised(w)
    step = 1.0
    for _ in range(rounds):
        slope, bend = ridge * w, np.full(len(w), ridge)
        for (x, y, times), code in zip(parts, one, strict=True):
            g, h = pl_gradient(x @ w, code, y)
            slope, bend = slope + times * (x.T @ g), bend + times * ((x * x).T @ h)
        move = slope / bend
        while step > 1e-4:
            new = w - step * move
            if signs is not None:
                new = np.where(signs > 0, np.maximum(new, 0), np.where(signs < 0, np.minimum(new, 0), new))
            after = penalised(new)
            if after <= loss:
                w, loss, step = new, after, min(1.0, 2 * step)
                break
            step /= 2
    return w


@dataclass
class Tree:
    """A regression tree, as arrays by node; column -1 is a leaf."""

    column: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray  # by column

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), int)
        while True:
            c = self.column[node]
            inner = c >= 0
            if not inner.any():
                return self.value[node]
            right = x[np.arange(len(x)), np.maximum(c, 0)] > self.cut[node]
            node = np.where(inner, np.where(right, self.right[node], self.left[node]), node)


def cut_points(x: np.ndarray, bins: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Quantiles between ``bins`` parts of a column, a row of weight n being n equal rows."""
    if weight is None:
        return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))
    order = np.argsort(x, kind="stable")
    upto = np.cumsum(weight[order], dtype=np.int64)
    at = np.linspace(0, 1, bins + 1)[1:-1] * (upto[-1] - 1)
    low, high = (x[order[np.searchsorted(upto, f(at), side="right")]] for f in (np.floor, np.ceil))
    return np.unique(low + (high - low) * (at - np.floor(at)))


def fit_tree(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, leaves: int = 31, depth: int = 8, least: int = 20, bins: int = 64, ridge: float = 1.0, columns: np.ndarray | None = None) -> Tree:
    """Grows the leaf of the greatest gain next, by second-order sums over quantile bins.

    ``columns`` are those it may split on.
    """
    columns = np.arange(x.shape[1]) if columns is None else columns
    edges = {c: cut_points(x[:, c], bins) for c in columns.tolist()}
    binned = {c: np.searchsorted(marks, x[:, c]).astype(np.uint16) for c, marks in edges.items()}
    return grow_tree(binned, edges, grad, hess, np.ones(len(x), np.uint16), x.shape[1], leaves, depth, least, ridge)[0]


def grow_tree(binned: dict[int, np.ndarray], edges: dict[int, np.ndarray], grad: np.ndarray, hess: np.ndarray, weight: np.ndarray, width: int, leaves: int = 31, depth: int = 8, least: int = 20, ridge: float = 1.0) -> tuple[Tree, np.ndarray]:
    """The tree over binned columns, and the leaf value of each row; ``grad`` and ``hess`` are weighted."""
    def best_split(rows: np.ndarray, level: int) -> tuple[float, int, int]:
        best = (1e-9, -1, 0)
        own, n_all = weight[rows], int(weight[rows].sum(dtype=np.int64))
        if level >= depth or n_all < 2 * least:
            return best
        gr, hr = grad[rows], hess[rows]
        g, h = gr.sum(), hr.sum()
        for c, marks in edges.items():
            if not len(marks):
                continue
            at = binned[c][rows]
            gl, hl, n = (np.cumsum(np.bincount(at, w, len(marks) + 1))[:-1] for w in (gr, hr, own))
            gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
            gain[(n < least) | (n_all - n < least)] = -np.inf
            if gain.max() > best[0]:
                best = (float(gain.max()), c, int(gain.argmax()))
        return best

    nodes = [[-1, 0.0, -1, -1, -grad.sum() / (hess.sum() + ridge)]]
    gains, heap = np.zeros(width), []
    out = np.full(len(grad), nodes[0][4])

    def offer(node: int, rows: np.ndarray, level: int) -> None:
        split = best_split(rows, level)
        if split[1] >= 0:
            heapq.heappush(heap, (-split[0], node, split, rows, level))

    offer(0, np.arange(len(grad), dtype=np.int32), 0)
    for _ in range(leaves - 1):
        if not heap:
            break
        _, node, (gain, c, mark), rows, level = heapq.heappop(heap)
        gains[c] += gain
        over = binned[c][rows] > mark
        for side, part in ((2, rows[~over]), (3, rows[over])):
            nodes[node][side] = len(nodes)
            nodes.append([-1, 0.0, -1, -1, -grad[part].sum() / (hess[part].sum() + ridge)])
            out[part] = nodes[-1][4]
            offer(len(nodes) - 1, part, level + 1)
        nodes[node][:2] = c, float(edges[c][mark])
    column, cut, left, right, value = (np.array(v) for v in zip(*nodes, strict=True))
    return Tree(column.astype(int), cut.astype(float), left.astype(int), right.astype(int), value.astype(float), gains), out


def fit_boosted(x: np.ndarray, codes: np.ndarray, label: np.ndarray, **options) -> list[Tree]:
    return fit_boosted_parts(parts_of(x, codes, label), **options)


def fit_boosted_parts(parts: list[Part], rounds: int = 60, rate: float = 0.05, fraction: float = 0.8, seed: int = 0, bins: int = 64, **options) -> list[Tree]:
    """Trees on the grouped gradient, each on a random ``fraction`` of the columns."""
    weight = np.repeat(np.array([times for _, _, times in parts]), [len(y) for _, y, _ in parts])
    edges = [cut_points(np.concatenate([x[:, c] for x, _, _ in parts]), bins, weight) for c in range(parts[0][0].shape[1])]
    groups = [(*merged(binned(x, edges), np.ones(len(y), np.int64), y), times) for x, y, times in parts]
    return fit_boosted_cells(groups, edges, rounds, rate, fraction, seed, **options)


Group = tuple[np.ndarray, np.ndarray, np.ndarray, int]


def bin_kind(edges: list[np.ndarray]) -> type:
    return np.uint8 if max(map(len, edges)) < 256 else np.uint16


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bin of each value, by row and column."""
    return np.stack([np.searchsorted(marks, x[:, c]).astype(bin_kind(edges)) for c, marks in enumerate(edges)], axis=1)


def cells_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each distinct row of bins, and which of these each row is."""
    code, count = np.zeros(len(at), np.int64), 1
    for c in range(at.shape[1]):
        wide = int(at[:, c].max(initial=0)) + 1
        if count * wide >= 1 << 62:
            found, code = np.unique(code, return_inverse=True)
            count = len(found)
        code, count = code * wide + at[:, c], count * wide
    return np.unique(code, return_index=True, return_inverse=True)[1:]


def merged(at: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins, how many rows have them and the sum of their labels, each row of bins once."""
    first, cell = cells_of(at)
    return at[first], np.bincount(cell, n, len(first)).astype(np.int64), np.bincount(cell, y, len(first))


def fit_boosted_cells(groups: list[Group], edges: list[np.ndarray], rounds: int = 60, rate: float = 0.05, fraction: float = 0.8, seed: int = 0, **options) -> list[Tree]:
    """``fit_boosted_parts`` of groups (bins, rows with them, sum of their labels, how often each counts).

    Trees split at edges of bins only, so rows of one group with the same bins have one score and
    one gradient at all times, and rows of all groups with the same bins end in one leaf. Bins
    are distinct within a group. ``groups`` is emptied.
    """
    rng = np.random.default_rng(seed)
    width = len(edges)
    first, cell = cells_of(at := np.concatenate([g[0] for g in groups]))
    at, cell = np.asfortranarray(at[first]), cell.astype(np.int32)
    bounds = np.cumsum([0, *[len(g[0]) for g in groups]])
    own = [(cell[i:j], n, y, times) for (_, n, y, times), i, j in zip(groups, bounds, bounds[1:], strict=False)]
    groups.clear()
    weight = np.zeros(len(first), np.int64)
    for c, n, _, times in own:
        weight[c] += times * n
    score, trees = np.zeros(len(first)), []
    some = max(1, int(round(fraction * width)))
    for _ in range(rounds):
        g, h = np.zeros(len(first)), np.zeros(len(first))
        for c, n, y, times in own:
            e = np.exp(score[c] - score[c].max())
            p = e / (n @ e)
            g[c] += times * (n * p - y)
            h[c] += times * n * np.maximum(p * (1 - p), HESSIAN_FLOOR)
        columns = np.sort(rng.choice(width, some, replace=False)).tolist()
        tree, value = grow_tree({c: at[:, c] for c in columns}, {c: edges[c] for c in columns}, g, h, weight, width, **options)
        trees.append(tree)
        score += rate * value
    return trees


def predict_boosted(trees: list[Tree], x: np.ndarray, rate: float = 0.05) -> np.ndarray:
    return rate * sum((t.predict(x) for t in trees), np.zeros(len(x)))


def bootstrap_groups(codes: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Row indices of groups drawn with replacement, and new codes: a group drawn twice is two."""
    order = np.argsort(codes, kind="stable")
    bounds = np.searchsorted(codes[order], np.arange(codes.max() + 2))
    drawn = rng.integers(0, codes.max() + 1, codes.max() + 1)
    rows = [order[bounds[g] : bounds[g + 1]] for g in drawn]
    return np.concatenate(rows), np.repeat(np.arange(len(drawn)), [len(r) for r in rows])


def walk_forward(rows: DataFrame, season: str, least: int = 5) -> DataFrame:
    """Every row once for each fold: ``fold`` is the held-out season, ``test`` marks its rows.

    A season is held out if at least ``least`` come before it; later seasons are left out.
    """
    seasons = rows.select(F.col(season).alias("s")).distinct()
    folds = seasons.alias("t").join(seasons.alias("e"), F.col("e.s") < F.col("t.s")).groupBy(F.col("t.s").alias("fold")).count().filter(F.col("count") >= least)
    return rows.join(F.broadcast(folds.select("fold")), rows[season] <= F.col("fold")).withColumn("test", F.col(season) == F.col("fold"))


def _numbers(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Columns as doubles by row, nulls as 0, the mean of a standardised column."""
    return np.stack([batch.column(c).cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns], axis=1)


def _blocks(rows: DataFrame, key: list[str], order: list[str], features: list[str], label: str) -> DataFrame:
    """key, number, x, y: runs of rows of one key as plain doubles, in order."""
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in key)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            own = batch.select(key).to_pandas()
            cuts = np.flatnonzero((own != own.shift()).any(axis=1)) if len(own) else np.array([], int)
            x = _numbers(batch, features)
            y = batch.column(label).cast(pa.float64()).to_numpy(zero_copy_only=False)
            ends = [*cuts[1:].tolist(), len(own)]
            spans = list(zip(cuts.tolist(), ends))
            head = [batch.column(c).take(pa.array(cuts)) for c in key]
            numbers = pa.array(range(number, number + len(spans)), pa.int64())
            number += len(spans)
            blobs = [pa.array([v[i:j].tobytes() for i, j in spans], pa.binary()) for v in (x, y)]
            yield pa.RecordBatch.from_arrays([*head, numbers, *blobs], names=[*key, "number", "x", "y"])

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(pack, f"{kinds}, number long, x binary, y binary")


@dataclass
class Deals:
    """Which fits there are, which groups each draws and how it standardises its rows."""

    rows: DataFrame
    key: list[str]
    found: list[tuple]  # the distinct keys, season first
    fits: list[tuple[int, int]]  # fold, k
    plan: list[tuple]  # fold, k, key, code of the group, how often it is drawn
    scale: dict[int, tuple[np.ndarray, np.ndarray]]  # mean and sd by fold


def _dealt(rows: DataFrame, *, season: str, group: list[str], features: list[str], label: str, order: list[str], replicates: int, least: int, seed: int, sealed: int | None = None) -> Deals:
    key = list(dict.fromkeys([season, *group]))
    rows = rows.filter(F.col(season).isNotNull()).select(*dict.fromkeys([*key, *order, *features, label]))
    found = [tuple(r) for r in rows.select(*key).distinct().collect()]
    name = [key.index(g) for g in group]
    seasons = sorted({r[0] for r in found})
    folds = [s for i, s in enumerate(seasons) if i >= least and (sealed is None or s <= sealed)]
    if not folds:
        return Deals(rows, key, found, [], [], {})
    plan = []
    for fold in folds:
        train = [r for r in found if r[0] < fold]
        names = sorted({tuple(r[i] for i in name) for r in train})
        codes = dict(zip(names, range(len(names))))
        for k in range(replicates):
            drawn = np.random.default_rng(seed_of(seed, int(fold), k)).integers(0, len(names), len(names))
            times = np.bincount(drawn, minlength=len(names)).tolist()
            plan += [(int(fold), k, *r, codes[own], times[codes[own]]) for r in train if times[codes[own := tuple(r[i] for i in name)]]]
    before = F.broadcast(rows.sparkSession.createDataFrame([(int(f),) for f in folds], "fold int"))
    plain = rows.select(season, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features]).join(before, F.col(season) < F.col("fold"))
    spread = [F.when(F.min(c) < F.max(c), F.stddev_pop(c)).otherwise(1.0) for c in features]
    scale = {r[0]: (np.array(r[1]), np.array(r[2])) for r in plain.groupBy("fold").agg(F.array(*[F.avg(c) for c in features]), F.array(*spread)).collect()}
    return Deals(rows, key, found, [(int(f), k) for f in folds for k in range(replicates)], plan, scale)


def _fitted(rows: DataFrame, fit: Callable, schema: str, *, features: list[str], label: str, order: list[str], **options) -> DataFrame:
    """What ``fit`` gives of each (fold, k): fold, k and the columns of ``schema``.

    fit(parts, seed of the fit, mean, sd) sees the groups that the resample drew from the
    seasons before the fold, each once with its count, standardised by all rows of these seasons.
    ``rows`` are read several times and should be a table. A fit holds its rows in one task, at
    8 bytes for each feature and label.
    """
    spark, seed = rows.sparkSession, options["seed"]
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    deals = _dealt(rows, features=features, label=label, order=order, **options)
    rows, key, scale = deals.rows, deals.key, deals.scale
    output = f"fold int, k int, {schema}"
    if not deals.fits:
        return spark.createDataFrame([], output)
    kind = T.StructType([T.StructField("fold", T.IntegerType()), T.StructField("k", T.IntegerType()), *[rows.schema[c] for c in key], T.StructField("code", T.IntegerType()), T.StructField("times", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, groups = None, {}

        def done() -> pa.RecordBatch:
            parts = []
            for code in sorted(groups):
                times, xs, ys = groups.pop(code)
                parts.append((np.concatenate(xs), np.concatenate(ys), times))
            made = fit(parts, seed_of(seed, *now), *scale[now[0]])
            return pa.RecordBatch.from_pylist([{"fold": now[0], "k": now[1], **made}], arrow)

        for batch in batches:
            for fold, k, code, times, x, y in zip(*[batch.column(c).to_pylist() for c in ("fold", "k", "code", "times", "x", "y")], strict=True):
                if now is not None and now != (fold, k):
                    yield done()
                now = fold, k
                mean, sd = scale[fold]
                own = groups.setdefault(code, (times, [], []))
                own[1].append((np.frombuffer(x).reshape(-1, len(features)) - mean) / sd)
                own[2].append(np.frombuffer(y))
        if now is not None:
            yield done()

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark.createDataFrame([], output).schema)
    last = max(f for f, _ in deals.fits)
    blocks = _blocks(rows.filter(F.col(key[0]) < last), key, order, features, label)
    fits = blocks.join(F.broadcast(spark.createDataFrame(deals.plan, kind)), key).repartition(SPREAD * len(deals.fits), "fold", "k").sortWithinPartitions("fold", "k", "code", *key, "number")
    return fits.select("fold", "k", "code", "times", "x", "y").mapInArrow(run, output)


def _edges(rows: DataFrame, deals: Deals, drawn: np.ndarray, features: list[str], bins: int) -> list[list[np.ndarray]]:
    """``cut_points`` of each fit's standardised columns, exact, without a task that holds a column.

    ``rows`` have the number of their key, own; ``drawn`` is how often a fit draws it, by key and
    fit. A sketch cuts each column into parts. Rows counted by part and fit tell in which part
    each wanted rank lies, and equal values of a part, in order, which value has it.
    """
    n_fits = drawn.shape[1]
    sketch = F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)])
    cuts = [np.unique(np.array(v)) for v in rows.agg(*[F.percentile_approx(c, sketch, F.lit(10 * PARTS)) for c in features]).first()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(features), PARTS, n_fits), np.int64)
        for batch in batches:
            times = drawn[batch.column("own").to_numpy()]
            for c, name in enumerate(features):
                part = np.searchsorted(cuts[c], batch.column(name).to_numpy())
                for f in range(n_fits):
                    sums[c, :, f] += np.bincount(part, times[:, f], PARTS).astype(np.int64)
        c, part, f = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32)) for v in (c, part, f)] + [pa.array(sums[c, part, f])], names=["c", "part", "fit", "n"])

    upto = np.zeros((len(features), PARTS, n_fits), np.int64)
    for r in rows.mapInArrow(count, "c int, part int, fit int, n long").groupBy("c", "part", "fit").agg(F.sum("n").alias("n")).collect():
        upto[r.c, r.part, r.fit] = r.n
    upto = np.cumsum(upto, axis=1)
    at = np.linspace(0, 1, bins + 1)[1:-1, None] * (upto[0, -1] - 1)
    wanted = {}
    for f in range(n_fits):
        ranks = np.unique(np.concatenate([np.floor(at[:, f]), np.ceil(at[:, f])]).astype(np.int64))
        for c in range(len(features)):
            parts = np.searchsorted(upto[c, :, f], ranks, side="right")
            for part in np.unique(parts).tolist():
                before = int(upto[c, part - 1, f]) if part else 0
                wanted.setdefault((c, part), []).append((f, before, ranks[parts == part] - before))
    needed = np.zeros((len(features), PARTS), bool)
    needed[tuple(zip(*wanted, strict=True))] = True

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, name in enumerate(features):
                v = batch.column(name).to_numpy()
                part = np.searchsorted(cuts[c], v).astype(np.int32)
                keep = np.flatnonzero(needed[c][part])
                own = batch.column("own").to_numpy()[keep]
                by = np.lexsort((own, v[keep]))
                v, own, part = v[keep][by], own[by], part[keep][by]
                first = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (own[1:] != own[:-1]))[: len(v)])
                n = np.diff(np.append(first, len(v)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), c, np.int32)), pa.array(part[first]), pa.array(own[first]), pa.array(v[first]), pa.array(n)], names=["c", "part", "own", "v", "n"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, past = None, np.zeros(n_fits, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            c, part, own, v, n = (batch.column(i).to_numpy() for i in range(5))
            starts = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (part[1:] != part[:-1]))[: len(c)]).tolist()
            out = []
            for i, j in zip(starts, [*starts[1:], len(c)], strict=True):
                if now != (spot := (int(c[i]), int(part[i]))):
                    now, past = spot, np.zeros(n_fits, np.int64)
                sums = past + np.cumsum(drawn[own[i:j]] * n[i:j, None], axis=0)
                for f, before, ranks in wanted[spot]:
                    here = ranks[(ranks >= past[f]) & (ranks < sums[-1, f])]
                    found = v[i:j][np.searchsorted(sums[:, f], here, side="right")]
                    out += [(spot[0], f, before + r, x) for r, x in zip(here.tolist(), found.tolist(), strict=True)]
                past = sums[-1]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.float64()), strict=True)], names=["c", "fit", "rank", "v"])

    parts = rows.mapInArrow(split, "c int, part int, own int, v double, n long").repartition("c", "part").groupBy("c", "part", "own", "v").agg(F.sum("n").alias("n"))
    picked = parts.sortWithinPartitions("c", "part", "v", "own").select("c", "part", "own", "v", "n").mapInArrow(pick, "c int, fit int, rank long, v double")
    value = {(r.c, r.fit, r["rank"]): r.v for r in picked.collect()}
    edges = []
    for f, (fold, _) in enumerate(deals.fits):
        mean, sd = deals.scale[fold]
        low, high = (np.array([[value[c, f, int(r)] for c in range(len(features))] for r in side(at[:, f])]) for side in (np.floor, np.ceil))
        low, high = (low - mean) / sd, (high - mean) / sd
        cut = low + (high - low) * (at[:, f] - np.floor(at[:, f]))[:, None]
        edges.append([np.unique(cut[:, c]) for c in range(len(features))])
    return edges


def _boosted(rows: DataFrame, fit: Callable, schema: str, *, group: list[str], features: list[str], label: str, bins: int = 64, **options) -> DataFrame:
    """What ``fit`` gives of each (fold, k): fold, k and the columns of ``schema``.

    fit(groups, edges, seed of the fit, mean, sd) sees what ``fit_boosted_cells`` takes of the
    groups that ``_fitted`` would give. Rows become counts by group and bins before they are sent,
    so a fit holds one entry for each group and distinct row of bins. ``rows`` are read several
    times and should be a table.
    """
    spark, seed = rows.sparkSession, options["seed"]
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    deals = _dealt(rows, group=group, features=features, label=label, order=[], **options)
    output = f"fold int, k int, {schema}"
    if not deals.fits:
        return spark.createDataFrame([], output)
    key, last = deals.key, max(f for f, _ in deals.fits)
    found = [r for r in deals.found if r[0] < last]
    names = [tuple(r[key.index(g)] for g in group) for r in found]
    number, place = {n: i for i, n in enumerate(sorted(set(names)))}, {r: i for i, r in enumerate(found)}
    code, which = [number[n] for n in names], {f: i for i, f in enumerate(deals.fits)}
    drawn = np.zeros((len(found), len(deals.fits)), np.int64)
    for fold, k, *own, _, times in deals.plan:
        drawn[place[tuple(own)], which[fold, k]] = times
    kind = T.StructType([*[deals.rows.schema[c] for c in key], T.StructField("own", T.IntegerType())])
    plain = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(features)]
    numbered = deals.rows.join(F.broadcast(spark.createDataFrame([(*r, i) for i, r in enumerate(found)], kind)), key)
    numbered = numbered.select("own", *plain, F.col(label).cast("double").alias("y"))
    xs = [f"x{i}" for i in range(len(features))]
    edges = _edges(numbered.drop("y"), deals, drawn, xs, bins)
    scale, which_fit = [deals.scale[fold] for fold, _ in deals.fits], deals.fits

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            own, x, y = batch.column("own").to_numpy(), _numbers(batch, xs), batch.column("y").to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (x[1:] != x[:-1]).any(axis=1))[: len(own)])
            if not len(first):
                continue
            n, y = np.diff(np.append(first, len(own))), np.add.reduceat(y, first)
            own, x = own[first], x[first]
            starts = np.flatnonzero(np.append(True, own[1:] != own[:-1])).tolist()
            for i, j in zip(starts, [*starts[1:], len(own)], strict=True):
                turn, out = turn + 1, []
                for f in np.flatnonzero(drawn[own[i]]).tolist():
                    cells = merged(binned((x[i:j] - scale[f][0]) / scale[f][1], edges[f]), n[i:j], y[i:j])
                    out.append({"fit": f, "code": code[own[i]], "times": int(drawn[own[i], f]), "own": int(own[i]), "turn": turn, **dict(zip(("at", "n", "y"), (v.tobytes() for v in cells), strict=True))})
                if out:
                    yield pa.RecordBatch.from_pylist(out, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, now, blocks = [], None, []

        def close() -> None:
            groups.append((*merged(*[np.concatenate(v) for v in zip(*blocks, strict=True)]), now[2]))
            blocks.clear()

        def done() -> pa.RecordBatch:
            fold, k = which_fit[now[0]]
            made = fit(groups, edges[now[0]], seed_of(seed, fold, k), *scale[now[0]])
            groups.clear()
            return pa.RecordBatch.from_pylist([{"fold": fold, "k": k, **made}], arrow)

        for batch in batches:
            for f, own, times, *cells in zip(*[batch.column(c).to_pylist() for c in ("fit", "code", "times", "at", "n", "y")], strict=True):
                if now is not None and now != (f, own, times):
                    close()
                    if now[0] != f:
                        yield done()
                now = f, own, times
                at, n, y = (np.frombuffer(v, t) for v, t in zip(cells, (bin_kind(edges[f]), np.int64, np.float64), strict=True))
                blocks.append((at.reshape(-1, len(features)), n, y))
        if now is not None:
            close()
            yield done()

    from pyspark.sql.pandas.types import to_arrow_schema

    sent = "fit int, code int, times int, own int, turn int, at binary, n binary, y binary"
    arrow, counts = (to_arrow_schema(spark.createDataFrame([], s).schema) for s in (output, sent))
    blocks = numbered.repartition("own").sortWithinPartitions("own", *xs, "y").mapInArrow(pack, sent)
    fits = blocks.repartition(SPREAD * len(deals.fits), "fit").sortWithinPartitions("fit", "code", "own", "turn")
    return fits.select("fit", "code", "times", "at", "n", "y").mapInArrow(run, output)


def _kept(rows: DataFrame, columns: list[str]) -> DataFrame:
    """These columns written once to the shared folder, as fits read them several times."""
    path = shared_dir(rows.sparkSession, "fits")
    rows.select(*dict.fromkeys(columns)).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def ensemble_scores(rows: DataFrame, *, keys: list[str], season: str, group: list[str], features: list[str], label: str, replicates: int = 8, learner: str = "linear", least: int = 5, seed: int = 5) -> DataFrame:
    """Out-of-fold scores: keys, fold, k, score; one task fits one (fold, k), all score.

    Each row is scored by every replicate of the one model that saw no later season. Null
    features count as 0, the mean of a standardised column. The fits run at once, and their
    models, which are small, pass through the driver.
    """
    rows = _kept(rows, [*keys, season, *group, *features, label])
    options = dict(season=season, group=group, features=features, label=label, replicates=replicates, least=least, seed=seed)
    spark = rows.sparkSession
    if learner == "linear":
        models = spark.createDataFrame(_linear(rows, None, order=keys, **options).collect(), MODEL)
        return score_with(rows, models, season=season, features=features, keys=keys)

    def fit(groups, edges, number, mean, sd):
        return {"mean": mean.tolist(), "sd": sd.tolist(), "trees": pickle.dumps(fit_boosted_cells(groups, edges))}

    found = {}
    for r in _boosted(rows, fit, "mean array<double>, sd array<double>, trees binary", **options).collect():
        found.setdefault(r.fold, []).append((r.k, np.array(r["mean"]), np.array(r.sd), pickle.loads(bytes(r.trees))))
    shared = spark.sparkContext.broadcast(found)
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, seasons = _numbers(batch, features), batch.column(season).to_numpy(zero_copy_only=False)
            for fold in np.unique(seasons).tolist():
                at = np.flatnonzero(seasons == fold)
                head = [batch.column(c).take(pa.array(at)) for c in keys]
                for k, mean, sd, trees in shared.value[fold]:
                    own = predict_boosted(trees, (x[at] - mean) / sd)
                    yield pa.RecordBatch.from_arrays([*head, pa.array([fold] * len(at), pa.int32()), pa.array([k] * len(at), pa.int32()), pa.array(own)], names=[*keys, "fold", "k", "score"])

    return rows.filter(F.col(season).isin(list(found))).select(*dict.fromkeys([*keys, season, *features])).mapInArrow(score, f"{kinds}, fold int, k int, score double")


def gain_importance(rows: DataFrame, *, season: str, group: list[str], features: list[str], label: str, replicates: int = 2, least: int = 5, seed: int = 5, top: int = 25) -> DataFrame:
    """feature, gain, place: the mean gain of boosted splits by feature over all folds, the ``top`` first."""
    rows = _kept(rows, [season, *group, *features, label])

    def fit(groups, edges, number, mean, sd):
        trees = fit_boosted_cells(groups, edges, seed=number)
        return {"gain": sum((t.gain for t in trees), np.zeros(len(features))).tolist()}

    fits = _boosted(rows, fit, "gain array<double>", season=season, group=group, features=features, label=label, replicates=replicates, least=least, seed=seed)
    pairs = F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"), F.col("gain").alias("gain"))
    found = fits.select(F.inline(pairs)).toDF("feature", "gain").groupBy("feature").agg(F.avg("gain").alias("gain"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("gain").desc(), "feature"))).filter(F.col("place") <= top)


MODEL = "fold int, k int, features array<string>, mean array<double>, sd array<double>, weights array<double>, digest string"


def feature_digest(features: list[str]) -> str:
    """Names the order of the features a model was fitted on."""
    return hashlib.sha256(",".join(features).encode()).hexdigest()[:16]


def _linear(rows: DataFrame, signs: dict[str, int] | None, *, features: list[str], **options) -> DataFrame:
    held = np.array([(signs or {}).get(f, 0) for f in features])

    def fit(parts, number, mean, sd):
        w = fit_linear_parts(parts, signs=held if held.any() else None)
        return {"features": features, "mean": mean.tolist(), "sd": sd.tolist(), "weights": w.tolist(), "digest": feature_digest(features)}

    return _fitted(rows, fit, MODEL.removeprefix("fold int, k int, "), features=features, **options)


def fit_models(rows: DataFrame, *, season: str, group: list[str], features: list[str], label: str, replicates: int = 8, least: int = 5, seed: int = 5, sealed: int | None = None, signs: dict[str, int] | None = None) -> DataFrame:
    """The linear ensembles as a table: one row a (fold, k), fitted on the seasons before the fold.

    ``sealed`` refuses folds that would train on that season or a later one; ``signs`` holds the
    weights of some features at or below 0 (-1) or at or above it (1).
    """
    rows = _kept(rows, [season, *group, *features, label])
    return _linear(rows, signs, season=season, group=group, features=features, label=label, order=[*features, label], replicates=replicates, least=least, seed=seed, sealed=sealed)


def fit_arms(rows: DataFrame, arms: dict[str, tuple[str, dict[str, int]]], **options) -> DataFrame:
    """``fit_models`` for each arm (its label column and held signs), under a column arm."""
    found = [fit_models(rows, label=label, signs=signs, **options).select(F.lit(name).alias("arm"), "*") for name, (label, signs) in arms.items()]
    return reduce(lambda a, b: a.unionByName(b), found)


def score_with(rows: DataFrame, models: DataFrame, *, season: str, features: list[str], keys: list[str]) -> DataFrame:
    """keys, fold, k, score of the rows of each fold's season, in column expressions.

    The model table has a row for each fold and replicate, so it is broadcast. A model whose
    feature digest is another raises.
    """
    same = F.col("digest") == feature_digest(features)
    models = models.withColumn("fold", F.when(same, F.col("fold")).otherwise(F.raise_error(F.lit("the models have other features")).cast("int")))
    x = F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in features])
    joined = rows.select(*keys, F.col(season).alias("__s"), x.alias("__x")).join(F.broadcast(models), F.col("__s") == F.col("fold"))
    z = F.zip_with(F.zip_with("__x", "mean", lambda a, m: a - m), "sd", lambda a, s: a / s)
    score = F.aggregate(F.zip_with(z, "weights", lambda a, w: a * w), F.lit(0.0), lambda a, b: a + b)
    return joined.select(*keys, "fold", "k", score.alias("score"))
