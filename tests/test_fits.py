"""Queries and operators that SQL cannot express, against plain numpy and Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapstride.functions import pricing
from snapstride.operators import model, quantiles, simulate
from snapstride.plans import catalog, volatility
from snapstride.sources import tables

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("n", [0, 1, 82, 150, 500, 1000])
def test_binomial_tail_for_any_number_of_trials(spark, n):
    cases = [(k, p) for k in sorted({0, 1, n // 3, n // 2, max(0, n - 1), n, n + 1}) for p in (0.02, 0.3, 0.5, 0.9, 0.995)]
    df = spark.createDataFrame([(k, n, p) for k, p in cases], "k long, n long, p double")
    got = df.select("k", "p", pricing.binomial_sf(F.col("k"), F.col("n"), F.col("p")).alias("sf")).collect()

    def term(i, p):
        return math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p))

    for r in got:
        assert abs(r.sf - min(1.0, math.fsum(term(i, r.p) for i in range(max(0, r.k), n + 1)))) < 1e-9, r


def test_mixture_is_the_mean_over_misses(spark):
    misses, cut = [3, 0, 5, 1, 0, 2], 4
    df = spark.createDataFrame([(k, n, p) for k in (0, 1, 10, 40) for n in (0, 5, 30, 80) for p in (0.1, 0.7, 0.99)], "k long, n long, p double")
    total = sum(misses) + cut
    mix = pricing.mixture_sf(F.col("k"), F.col("n"), F.col("p"), F.array(*[F.lit(m).cast("long") for m in misses]), F.lit(total))
    each = [pricing.binomial_sf(F.col("k"), F.greatest(F.lit(0).cast("long"), F.col("n") - m), F.col("p")) * c for m, c in enumerate(misses)]
    none = pricing.binomial_sf(F.col("k"), F.lit(0).cast("long"), F.col("p")) * cut
    for r in df.select(mix.alias("a"), ((sum(each[1:], each[0]) + none) / total).alias("b")).collect():
        assert abs(r.a - r.b) < 1e-9


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(0)
    values = {"many": rng.normal(size=60_000), "ties": rng.integers(0, 5, 9000).astype(float), "few": np.array([3.0, 1.0]), "one": np.array([2.0])}
    rows = [(k, float(v)) for k, x in values.items() for v in x] + [("few", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    for q in (0.0, 0.05, 0.5, 0.8, 1.0):
        got = {r.g: r.x for r in quantiles.percentile(df, ["g"], "v", q, "x").collect()}
        assert all(abs(got[k] - np.quantile(x, q)) < 1e-12 for k, x in values.items())
        assert abs(quantiles.percentile(df, [], "v", q, "x").first().x - np.quantile(np.concatenate(list(values.values())), q)) < 1e-12


def test_weighted_quantiles_are_exact(spark):
    rng = np.random.default_rng(1)
    groups = {"a": (rng.normal(size=20_000), rng.random(20_000)), "b": (rng.integers(0, 4, 500).astype(float), rng.random(500)), "c": (np.array([1.0]), np.array([0.3]))}
    df = spark.createDataFrame([(k, float(v), float(w)) for k, (x, y) in groups.items() for v, w in zip(x, y)], "g string, v double, w double").repartition(5)
    for q in (0.1, 0.5, 0.9):
        for r in quantiles.weighted(df, ["g"], "v", "w", q, "x").collect():
            v, w = groups[r.g]
            order = np.argsort(v, kind="stable")
            at = np.searchsorted(np.cumsum(w[order]) / w.sum(), q)
            assert r.x == v[order][at] and abs(r.n_eff - w.sum() ** 2 / (w**2).sum()) < 1e-6


def _points(spark):
    """t, rv and the basis inputs of each point, by plain loops over the series."""
    from snapstride.plans import roles

    out = []
    rows = roles.daily_prices(spark, SF).orderBy("candidate", "i").collect()
    series = {}
    for r in rows:
        series.setdefault(r.candidate, []).append(r.price)
    for prices in series.values():
        n = len(prices)
        if n < 12:
            continue
        z = [math.log(p / (1 - p)) for p in (min(max(x, 0.005), 0.995) for x in prices)]
        for t in range(5, n - 1, 4):
            for h in volatility.GLM_HORIZONS:
                if t + h >= n:
                    break
                rv = math.sqrt(np.mean([(z[k + 1] - z[k]) ** 2 for k in range(t, t + h)]))
                if rv > 0:
                    al, frac, fav, lh = abs(z[t]), t / (n - 1), float(prices[t] > 0.5), math.log(h)
                    out.append(([1, al, al * al, n - 1 - t, frac, lh, h, al * lh, frac * lh, frac * frac, fav, fav * frac, fav * al], math.log(rv)))
    return np.array([x for x, _ in out], float), np.array([y for _, y in out])


def test_cross_section_weights_are_those_of_numpy(spark):
    x, y = _points(spark)
    want = np.linalg.solve(x.T @ x + volatility.RIDGE * np.eye(13), x.T @ y)
    rows = catalog.queries()["forward_vol_fit"](spark, SF).collect()
    got = {r.term: r.weight for r in rows if r.part == "glm"}
    assert np.allclose([got[t] for t in volatility.TERMS], want, atol=1e-5)
    fade = {r.term: r.weight for r in rows if r.part == "fade"}
    assert set(fade) == {"frac_0", "frac_1", "price_0", "price_1", "loss"} and fade["loss"] >= 0


def test_fades_find_the_least_loss(spark):
    rng = np.random.default_rng(2)
    n = 400
    cross, jump, own = rng.uniform(0.1, 0.5, (3, n))
    frac, al = rng.random(n), rng.uniform(0, 4, n)
    late, out = 1 / (1 + np.exp(-(-2 + 5 * frac))), 1 / (1 + np.exp(-(-3 + 2 * al)))
    rv = (1 - late) * cross + late * (out * jump + (1 - out) * own)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(rv, cross, jump, own, frac, al)], "rv double, glm_vol double, jump_vol double, own_vol double, frac double, al double")
    found, loss = volatility.fit_fades(df, rounds=7)
    start = volatility.fit_fades(df, rounds=0)[1]
    assert loss < 0.2 * start and abs(found[1] - 5) < 2.5


def naive_positions(trades):
    """The fold, trade by trade."""
    done, now, cash, refused = [], None, 0.0, 0
    for side, delta, eff, mid, fair in trades:
        if abs(delta) < 1e-12:
            continue
        if now is not None and now["shares"] > 1e-9 and now["side"] != side and delta > 0:
            refused += 1
            continue
        if now is None:
            now, cash = {"side": side, "shares": 0.0, "bought": 0.0, "cash_in": 0.0, "trimmed": 0.0, "trim_cash": 0.0, "fair_in": 0.0, "fills": 0}, 0.0
        cash -= delta * eff
        if delta > 0:
            now["shares"] += delta
            now["bought"] += delta
            now["cash_in"] += delta * eff
            now["fair_in"] += delta * (fair or 0.0)
        else:
            cut = min(-delta, now["shares"])
            now["shares"] -= cut
            now["trimmed"] += cut
            now["trim_cash"] += cut * eff
        now["fills"] += 1
        if now["shares"] <= 1e-9:
            done.append((now, True, cash, refused))
            now, cash, refused = None, 0.0, 0
    if now is not None:
        done.append((now, False, cash, refused))
    return done


def test_positions_are_those_of_a_plain_fold(spark):
    from snapstride.plans import ledger as plans

    trades = plans._trades(spark, SF).orderBy("candidate", "ts", "event_id").collect()
    by = {}
    for r in trades:
        by.setdefault(r.candidate, []).append((r.side, r.delta, r.eff, r.mid, r.fair))
    got = {}
    for r in catalog.queries()["position_ledger"](spark, SF).collect():
        got[r.candidate, r.number] = r
    closed = 0
    for c, own in by.items():
        for i, (p, shut, cash, refused) in enumerate(naive_positions(own)):
            r = got.pop((c, i))
            closed += shut
            assert (r.side, r.closed, r.fills, r.refused) == (p["side"], shut, p["fills"], refused)
            assert all(abs(r[k] - p[k]) < 1e-6 for k in ("shares", "bought", "cash_in", "trimmed", "trim_cash", "fair_in")) and abs(r.cash - cash) < 1e-6
    assert not got and closed > 10


def test_out_of_fold_scores_are_spread_over_all_rows(spark):
    scored = catalog.queries()["pl_ensemble_fit"](spark, "/root/testdata/sf0.001")
    rows = scored.toPandas()
    assert not rows.duplicated(["player_id", "season", "snapshot_date"]).any()
    sums = rows.groupby(["season", "snapshot_date"]).share.sum()
    assert (abs(sums - 1) < 1e-9).all() and (rows.k > 1).all()


def test_moves_are_drawn_around_the_point(spark):
    rng = np.random.default_rng(3)
    rows = [(7, float(f), float(z), float(0.4 * np.sign(z) + rng.normal(0, 0.05))) for f, z in zip(rng.uniform(0.4, 0.6, 3000), rng.choice([-1.5, 1.5], 3000))]
    corpus = simulate.move_corpus(spark.createDataFrame(rows, "h int, frac double, z double, net double"))
    assert corpus[7][:, 3].sum() == 3000 and len(corpus[30]) == 0
    high, low = (simulate.sample_moves(corpus, 7, p, 0.5, 0.1, 4000, np.random.default_rng(1)) for p in (0.82, 0.18))
    assert abs(high.mean() - 0.4) < 0.05 and abs(low.mean() + 0.4) < 0.05 and high.std() < 0.2
    thin = simulate.sample_moves({**corpus, 7: corpus[7][:0]}, 7, 0.5, 0.5, 0.1, 4000, np.random.default_rng(1))
    assert abs(thin.std() - 0.1 * 7**0.5) < 0.02  # no past move: the volatility alone
    few = simulate.sample_moves({7: np.array([[0.5, 0.0, 0.2, 6.0]])}, 7, 0.5, 0.5, 0.3, 4000, np.random.default_rng(1))
    assert 0.3 < few.std() < 0.3 * 7**0.5  # six rows of fifteen: two fifths of the draws


def test_feeds_written_as_json_and_stamped(spark, tmp_path):
    df = spark.createDataFrame([("MVP", 1.5, None), ("ROTY", None, 2)], "book string, pnl double, n int")
    tables.write_json(df, f"file://{tmp_path}/books")
    back = spark.read.schema(df.schema).json(f"file://{tmp_path}/books")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert tables.utc_stamp(df, "at", "2024-05-01 10:00:00").first().at == "2024-05-01T10:00:00Z"
    tables.write_csv(tables.union_rows([df, spark.createDataFrame([("X", [1, 2])], "book string, days array<int>")]), f"file://{tmp_path}/log")
    rows = spark.read.option("header", True).csv(f"file://{tmp_path}/log").collect()
    assert len(rows) == 3 and {r.days for r in rows} == {None, "[1,2]"}


def test_marks_and_residuals(spark):
    done = spark.createDataFrame([("logs", 2001, 0), ("logs", 2002, 3)], "pull_type string, season int, n_failed long")
    found = spark.createDataFrame([(2002, 1), (2003, 2)], "season int, n_failed long")
    marked = tables.mark_complete(done, "logs", found)
    assert {(r.season, r.n_failed) for r in marked.collect()} == {(2001, 0), (2002, 1), (2003, 2)}
    assert [r.season for r in tables.residual(marked, "logs").collect()] == [2003, 2002]
    with pytest.raises(ValueError):
        tables.keep_columns(done, ["season", "gone"])
    assert tables.keep_columns(done, ["season"], always=["n_failed", "moon"]).columns == ["season", "n_failed"]


def test_a_hard_winner_resampled_gives_the_soft_weights(spark):
    """The mean of one-hot winners drawn from each softmax is the mean of the softmaxes."""
    rng = np.random.default_rng(4)
    cloud = rng.normal(size=(200, 5))
    soft = np.exp(cloud) / np.exp(cloud).sum(axis=1, keepdims=True)
    hard = np.mean([np.eye(5)[[rng.choice(5, p=p) for p in soft]].mean(axis=0) for _ in range(60)], axis=0)
    assert np.abs(hard - soft.mean(axis=0)).max() < 0.02


def test_trees_grow_the_best_leaf_within_their_bounds():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 3))
    want = np.where(x[:, 0] > 0, 2.0, 0.0) + np.where((x[:, 0] > 0) & (x[:, 1] > 1), 3.0, 0.0)
    tree = model.fit_tree(x, -want, np.ones(4000), leaves=3)
    assert (tree.column >= 0).sum() == 2 and set(tree.column[tree.column >= 0]) == {0, 1}
    assert np.abs(tree.predict(x) - want).mean() < 0.1 and tree.gain[2] == 0
    full = model.fit_tree(x, -rng.normal(size=4000), np.ones(4000))
    assert (full.column < 0).sum() <= 31
    node = np.zeros(4000, int)
    for _ in range(9):
        c = full.column[node]
        node = np.where(c >= 0, np.where(x[np.arange(4000), np.maximum(c, 0)] > full.cut[node], full.right[node], full.left[node]), node)
    assert (full.column[node] < 0).all() and np.bincount(node)[np.unique(node)].min() >= 20


def test_arms_hold_their_signs(spark):
    rows = catalog.queries()["retrain_arms"](spark, "/root/testdata/sf0.001").collect()
    assert {r.arm for r in rows} == {"baseline", "monotone", "vs", "fp"}
    assert all(r.weights[2] <= 0 for r in rows if r.arm == "monotone")


def _groups():
    rng = np.random.default_rng(6)
    codes, times = np.repeat(np.arange(6), 50), [2, 1, 0, 3, 1, 1]
    x = rng.normal(size=(300, 3))
    y = model.group_softmax(x[:, 0] - 2 * x[:, 1], codes)
    again = np.concatenate([np.flatnonzero(codes == g) for g, n in enumerate(times) for _ in range(n)])
    parts = [(x[codes == g], y[codes == g], n) for g, n in enumerate(times) if n]
    return parts, x[again], np.repeat(np.arange(sum(times)), 50), y[again]


def test_a_group_drawn_twice_counts_twice_in_linear_fits(spark):
    parts, x, codes, y = _groups()
    assert np.allclose(model.fit_linear_parts(parts), model.fit_linear(x, codes, y), atol=1e-9)
    rows = spark.createDataFrame([(s, i, float(i), 0.25) for s in range(2000, 2003) for i in range(4)], "season int, i int, x double, y double")
    models = model.fit_models(rows, season="season", group=["season"], features=["x"], label="y", replicates=2, least=1)
    plan = models._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "explode" not in plan and models.count() == 4  # no task holds its rows as a data frame


def test_a_group_drawn_twice_counts_twice_in_tree_fits():
    parts, x, codes, y = _groups()
    one, two = model.fit_boosted_parts(parts, rounds=5), model.fit_boosted(x, codes, y, rounds=5)
    assert np.allclose(model.predict_boosted(one, x), model.predict_boosted(two, x), atol=1e-9)
    assert all(np.array_equal(a.column, b.column) for a, b in zip(one, two))


def _plain_trees(x, codes, y, rounds=60, rate=0.05):
    """Boosting row by row, a group drawn twice being two."""
    rng, score, trees = np.random.default_rng(0), np.zeros(len(x)), []
    for _ in range(rounds):
        columns = np.sort(rng.choice(x.shape[1], max(1, round(0.8 * x.shape[1])), replace=False))
        trees.append(model.fit_tree(x, *model.pl_gradient(score, codes, y), columns=columns))
        score += rate * trees[-1].predict(x)
    return trees


def _tree_rows():
    """Groups that span seasons; ties, nulls, a constant, and each row several times."""
    rng, rows = np.random.default_rng(7), []
    for season in range(2000, 2003):
        for g in range(4):
            for _ in range(60):
                a, b = float(rng.normal()), float(rng.integers(0, 4))
                rows += [(season, g, None if b == 3 else b, a, 1.5, float(a > 1))] * int(rng.integers(1, 9))
    return [(i, *r) for i, r in enumerate(rows)]


TREE_ROWS = "id int, season int, g int, b double, a double, one double, y double"


def test_tree_ensembles_score_as_fits_of_every_drawn_row(spark):
    rows = _tree_rows()
    got = model.ensemble_scores(spark.createDataFrame(rows, TREE_ROWS).repartition(5), keys=["id"], season="season", group=["g"], features=["b", "a", "one"], label="y", replicates=2, learner="trees", least=1)
    got = {(r.id, r.k): r.score for r in got.collect()}
    data = np.array([[0.0 if v is None else v for v in r] for r in rows])
    for fold in (2001, 2002):
        old, new = data[data[:, 1] < fold], data[data[:, 1] == fold]
        mean, sd = old[:, 3:6].mean(axis=0), old[:, 3:6].std(axis=0)
        sd[2] = 1.0
        for k in range(2):
            drawn = np.random.default_rng(model.seed_of(5, fold, k)).integers(0, 4, 4)
            parts = [old[old[:, 2] == g] for g in np.sort(drawn)]
            every, codes = np.concatenate(parts), np.repeat(np.arange(4), [len(p) for p in parts])
            trees = _plain_trees((every[:, 3:6] - mean) / sd, codes, every[:, 6])
            want = model.predict_boosted(trees, (new[:, 3:6] - mean) / sd)
            assert np.abs(want - [got.pop((int(i), k)) for i in new[:, 0]]).max() < 1e-9 and want.std() > 0.01
    assert not got


def test_a_tree_fit_holds_bins_and_not_rows(spark):
    """Thirty times the rows are sent and held as hardly more entries, with thirty times the counts."""
    def size(groups, edges, number, mean, sd):
        return {"held": sum(len(g[1]) for g in groups), "stood": int(sum(g[1].sum() for g in groups)), "marks": sum(map(len, edges))}

    def held(times):
        rows = spark.createDataFrame(_tree_rows() * times, TREE_ROWS)
        fits = model._boosted(rows, size, "held long, stood long, marks long", season="season", group=["g"], features=["b", "a", "one"], label="y", replicates=1, least=1, seed=5)
        return sorted(map(tuple, fits.collect()))

    few, many = held(1), held(30)
    assert len(few) == 2 and [(f, k, 30 * m) for f, k, _, m, _ in few] == [(f, k, m) for f, k, _, m, _ in many]
    assert all(abs(a[2] - b[2]) < 10 and b[2] < b[3] / 80 for a, b in zip(few, many, strict=True))


def test_cut_points_found_by_parts_are_exact(spark):
    """Each fit's edges are the weighted quantiles of its rows, ties of a thousand included."""
    rng = np.random.default_rng(8)
    own = rng.integers(0, 3, 6000)
    x = np.stack([rng.normal(size=6000), rng.integers(0, 3, 6000).astype(float), np.where(rng.random(6000) < 0.9, 0.0, rng.normal(size=6000))], axis=1)
    drawn = np.array([[1, 0], [2, 1], [0, 5]])
    scale = {1: (np.array([0.1, 0.0, 0.3]), np.array([2.0, 1.0, 0.5]))}
    rows = spark.createDataFrame([(int(o), *map(float, r)) for o, r in zip(own, x)], "own int, x0 double, x1 double, x2 double").repartition(4)
    deals = model.Deals(rows, [], [], [(1, 0), (1, 1)], [], scale)
    for f, edges in enumerate(model._edges(rows, deals, drawn, ["x0", "x1", "x2"], 64)):
        w = drawn[own, f]
        z = (x[w > 0] - scale[1][0]) / scale[1][1]
        assert all(np.array_equal(e, model.cut_points(z[:, c], 64, w[w > 0])) for c, e in enumerate(edges))
