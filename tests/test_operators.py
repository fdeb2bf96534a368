import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapstride.functions import classify, parse, pricing
from snapstride.operators import asof, model, relative, simulate


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_latest_takes_the_greatest_order_on_ties(spark):
    left = spark.createDataFrame([(1, 5), (1, 2), (2, 9), (3, 1)], "k int, at int")
    right = spark.createDataFrame([(1, 5, 1, "a"), (1, 5, 2, "b"), (1, 1, 0, "c"), (2, 10, 0, "d")], "k int, t int, o int, v string")
    got = {(r.k, r.at): r.v for r in asof.latest(left, right, ["k"], "at", "t", ["o"], ["v"]).collect()}
    assert got == {(1, 5): "b", (1, 2): "c", (2, 9): None, (3, 1): None}


def test_sealed_price_respects_both_ends(spark):
    day = dt.datetime(2024, 1, 2)
    left = spark.createDataFrame([("x", day), ("y", day), ("z", day)], "k string, at timestamp_ntz")
    ticks = [("x", day, 0.1), ("x", day + dt.timedelta(hours=1), 0.2), ("y", day + dt.timedelta(days=4), 0.3), ("z", day - dt.timedelta(seconds=1), 0.4)]
    right = spark.createDataFrame(ticks, "k string, ts timestamp_ntz, p double")
    got = {r.k: r.p for r in asof.first_within(left, right, ["k"], "at", "ts", "p", 3).collect()}
    assert got == {"x": 0.1, "y": None, "z": None}
    band = asof.last_within(left, right, ["k"], "at", "ts", "p", 4, lambda p: (p > 0.2) & (p < 0.99))
    assert {r.k: r.p for r in band.collect()} == {"x": None, "y": None, "z": 0.4}


def test_ranks_treat_nulls_as_asked(spark):
    df = spark.createDataFrame([(1, None), (1, 1.0), (1, 2.0), (2, 5.0)], "g int, x double")
    got = [(r.g, r.x, r.pool, r.own) for r in df.select("g", "x", relative.pool_rank("x", ["g"]).alias("pool"), relative.member_rank("x", ["g"]).alias("own")).collect()]
    assert set(got) == {(1, None, 0.0, None), (1, 1.0, 0.5, 0.0), (1, 2.0, 1.0, 1.0), (2, 5.0, 0.0, 0.0)}
    flat = spark.createDataFrame([(1, 3.0), (1, 3.0)], "g int, x double").select(relative.zscore("x", ["g"]).alias("z")).collect()
    assert [r.z for r in flat] == [None, None]


@pytest.mark.parametrize(("needed", "n", "p"), [(0, 5, 0.5), (3, 5, 0.5), (6, 5, 0.5), (65, 82, 0.8), (1, 82, 0.02), (82, 82, 0.995)])
def test_binomial_survival(spark, needed, n, p):
    from math import comb

    exact = sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(needed, n + 1)) if n >= needed else 0.0
    got = one(spark, pricing.binomial_sf(F.col("k"), F.col("n"), F.col("p")), k=needed, n=n, p=p)
    assert got == pytest.approx(exact, abs=1e-10)


def test_spread_is_monotone_and_clamped(spark):
    prices = [(i / 200,) for i in range(0, 201)]
    got = [r.s for r in spark.createDataFrame(prices, "p double").select("p", pricing.half_spread(F.col("p")).alias("s")).orderBy("p").collect()]
    assert all(a >= b for a, b in zip(got, got[1:])) and got[0] == pricing.CAP and got[-1] == pricing.FLOOR


def test_projection_holds_inside_the_band(spark):
    def at(t, c, w):
        return one(spark, pricing.project(F.col("t"), F.col("c"), F.col("w")), t=float(t), c=float(c), w=float(w))

    assert (at(10, 12, 3), at(10, 20, 3), at(10, 0, 3)) == (12, 13, 7)


@pytest.mark.parametrize(
    ("text", "category"),
    [("Injury/Illness - Left Achilles; Soreness", "minor"), ("Injury/Illness - Left Achilles; Tear", "season_ending"), ("Achilles", "season_ending"), ("", "unknown"), (None, "unknown"), ("Injury/Illness - N/A; Illness", "illness"), ("Rest", "rest")],
)
def test_reason(spark, text, category):
    assert one(spark, classify.reason(F.col("t").cast("string")), t=text) == category


def test_finals_mvp_is_another_award(spark):
    assert one(spark, classify.award(F.col("t"), F.col("s")), t="Finals MVP", s="x") == "OTHER"
    assert one(spark, classify.award(F.col("t"), F.col("s")), t="The_M-V-P", s="nba-mvp") == "MVP"


def test_html_table(spark):
    html = """<p><!-- <table id="mvp"><tr><th data-stat="rank">Rank</th><th data-stat="player">Player</th></tr>
    <tr><th data-stat="rank">1T</th><td data-stat="player"><a href="/p/a/ab01.html">A B</a></td><td data-stat="points_won">1,010.0</td><td data-stat="award_share">0.9</td></tr></table> -->"""
    df = spark.createDataFrame([(html,), (None,)], "html string")
    opened = df.select(parse.uncomment_tables("html").alias("html"))
    assert "<!--" not in opened.first().html
    spark.udtf.register("vote_table", parse.vote_table())
    df.createOrReplaceTempView("vote_pages")
    rows = spark.sql("SELECT v.* FROM vote_pages, LATERAL vote_table(html, 'mvp') v").collect()
    assert [(r.bref_id, r.name, r.total_points, r.rank, r.won_flag) for r in rows] == [("ab01", "A B", 1010.0, 1, 1)]


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    codes = np.repeat(np.arange(4), 5)
    s, y = rng.normal(size=20), rng.dirichlet(np.ones(5), 4).ravel()
    g, h = model.pl_gradient(s, codes, y)
    for i in range(20):
        e = np.eye(20)[i] * 1e-6
        assert g[i] == pytest.approx((model.grouped_loss(s + e, codes, y) - model.grouped_loss(s - e, codes, y)) / 2e-6, abs=1e-6)
    assert (h >= model.HESSIAN_FLOOR).all()


@pytest.mark.parametrize("learner", ["linear", "trees"])
def test_learners_lower_the_loss(learner):
    rng = np.random.default_rng(2)
    codes = np.repeat(np.arange(30), 10)
    x = rng.normal(size=(300, 3))
    y = model.group_softmax(2 * x[:, 0] - x[:, 1], codes)
    score = x @ model.fit_linear(x, codes, y) if learner == "linear" else model.predict_boosted(model.fit_boosted(x, codes, y), x)
    assert model.grouped_loss(score, codes, y) < 0.9 * model.grouped_loss(np.zeros(300), codes, y)


def test_sign_constraints_hold():
    rng = np.random.default_rng(3)
    codes, x = np.repeat(np.arange(20), 5), rng.normal(size=(100, 2))
    y = model.group_softmax(x[:, 0] + x[:, 1], codes)
    w = model.fit_linear(x, codes, y, signs=np.array([-1, 0]))
    assert w[0] <= 0 < w[1]


def test_bootstrap_keeps_groups_whole():
    codes = np.array([0, 1, 1, 2, 2, 2])
    rows, again = model.bootstrap_groups(codes, np.random.default_rng(0))
    for g in np.unique(again):
        members = rows[again == g]
        assert sorted(members) == sorted(np.flatnonzero(codes == codes[members[0]]))


def test_no_fold_sees_its_season(spark):
    rows = spark.createDataFrame([(s, i) for s in range(2000, 2006) for i in range(3)], "season int, i int")
    folds = model.walk_forward(rows, "season", 3)
    assert folds.filter("season > fold or (test and season <> fold)").count() == 0
    assert {r.fold for r in folds.select("fold").distinct().collect()} == {2003, 2004, 2005}


def test_l1_projection():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a = rng.normal(size=5) * 10
        p = simulate.project_l1(a, 7.0)
        assert np.abs(p).sum() <= 7 + 1e-9 and (np.sign(p) * np.sign(a) >= 0).all()


def test_kelly_is_near_the_best_of_a_grid():
    q, price = np.array([0.6, 0.4]), np.array([0.4, 0.5])
    flat = np.zeros(2)
    best = simulate.kelly_solve(q, price, 100.0, 50.0, flat, flat, np.ones(2, bool))
    grid = [np.array([a, b]) for a in np.linspace(-50, 50, 41) for b in np.linspace(-50, 50, 41) if abs(a) + abs(b) <= 50]
    top = max(simulate.log_growth(a, q, price, 100.0, flat, flat) for a in grid)
    assert simulate.log_growth(best, q, price, 100.0, flat, flat) >= top - 2e-3


def _region(**options):
    from snapstride.operators.region import Region

    region = Region(**options)

    def step(target, held, snapshot, fair=0.5, price=0.5, cost=0.01, **more):
        return float(region.step(["x"], [target], [held], [fair], [price], lambda size: np.full(len(size), cost), 1000.0, snapshot, **more)[0])

    return step


def test_a_reversal_waits_for_fresh_snapshots():
    step = _region()
    assert step(-50.0, 40.0, "a") == 40.0
    assert step(-50.0, 40.0, "a") == 40.0  # the same snapshot does not count again
    assert step(-50.0, 40.0, "b") == -50.0
    assert step(30.0, 0.0, "b") == 30.0


def test_the_band_holds_trims_by_drift_and_closes_on_command():
    width = 2 * 0.01 / 1.0 * 1000  # cost over a curvature of about one at even odds
    assert _region()(100.0, 100.0 - 0.5 * width, "a") == 100.0 - 0.5 * width  # inside the band
    assert abs(_region()(300.0, 200.0, "a") - (300.0 - width / (0.5 / 1.3**2 + 0.5 / 0.7**2))) < 1e-6  # to its edge
    trims = {}
    for name, second in (("up", 0.6), ("still", 0.5), ("down", 0.4)):
        step = _region()
        step(100.0, 100.0, "a", fair=0.5)
        trims[name] = 400.0 - step(100.0, 400.0, "b", fair=second)
    assert 0 < trims["up"] < trims["still"] < trims["down"]
    assert _region()(100.0, 100.0, "a", out=[True]) == 0.0
    assert _region()(100.0, 0.0, "a", radj=np.array([0.01])) == 0.0  # below the hurdle nothing opens
    assert abs(_region()(100.0, 0.0, "a", sigma=np.array([0.5])) - 100 / 2.6) < 1e-9
    assert _region(least_trade=0.5)(300.0, 200.0, "a") == 200.0


def test_garch_gives_up_on_short_series():
    assert simulate.garch_variances(np.ones(10), 3) is None
    v = simulate.garch_variances(np.random.default_rng(0).normal(size=200) * 0.1, 5)
    assert v.shape == (5,) and (v > 0).all() and 0.03 < np.sqrt(v[0]) < 0.3


def test_simulations_repeat(spark):
    from snapstride.plans import catalog

    run = catalog.queries()["joint_samples"]
    a, b = (sorted(map(tuple, run(spark, "/root/testdata/sf0.001").collect())) for _ in range(2))
    assert a == b


def test_models_as_a_table(spark):
    rng = np.random.default_rng(6)
    rows = [(s, g, i, float(x), float(np.exp(2 * x))) for s in range(2000, 2005) for g in range(4) for i, x in enumerate(rng.normal(size=6))]
    df = spark.createDataFrame(rows, "season int, g int, i int, x double, y double")
    df = df.withColumn("y", F.expr("y / sum(y) over (partition by season, g)"))
    models = model.fit_models(df, season="season", group=["season", "g"], features=["x"], label="y", replicates=2, least=3).cache()
    assert {(r.fold, r.k) for r in models.collect()} == {(f, k) for f in (2003, 2004) for k in (0, 1)}
    scored = model.score_with(df, models, season="season", features=["x"], keys=["season", "g", "i", "x"])
    assert scored.count() == 2 * 2 * 24 and scored.select(F.corr("x", "score")).first()[0] > 0.9
    assert model.fit_models(df, season="season", group=["season", "g"], features=["x"], label="y", replicates=2, least=3, sealed=2003).count() == 2
    with pytest.raises(Exception, match="other features"):
        model.score_with(df.withColumn("z", F.col("x")), models, season="season", features=["z"], keys=["i"]).collect()


def test_gradient_of_all_names_is_that_of_each():
    rng = np.random.default_rng(4)
    q, price, a = rng.dirichlet(np.ones(9)), rng.uniform(0.05, 0.6, 9), rng.normal(0, 4, 9)
    rest = (q, price, 1000.0, np.full(9, 0.02), rng.normal(0, 4, 9))
    each = [(simulate.log_growth(a + 0.01 * e, *rest) - simulate.log_growth(a - 0.01 * e, *rest)) / 0.02 for e in np.eye(9)]
    assert np.allclose(simulate.growth_gradient(a, *rest, 0.01), each, rtol=1e-6, atol=1e-9)


def test_gradient_of_many_names_is_that_of_each_and_quick():
    rng = np.random.default_rng(8)
    for scale, n in ((2.0, 40), (60.0, 40)):  # far from ruin, and close to it
        q, price, a = rng.dirichlet(np.ones(n)) * (rng.random(n) > 0.2), rng.uniform(0.01, 0.99, n), rng.normal(0, scale / 4, n)
        rest = (q, price, 20 * scale, np.full(n, 0.02), np.where(rng.random(n) < 0.5, a, 0))
        each = [(simulate.log_growth(a + 0.05 * e, *rest) - simulate.log_growth(a - 0.05 * e, *rest)) / 0.1 for e in np.eye(n)]
        assert np.allclose(simulate.growth_gradient(a, *rest, 0.05), each, rtol=1e-6, atol=1e-8)
    n = 2000
    q, price = rng.dirichlet(np.ones(n)), rng.uniform(0.05, 0.95, n)
    rest = (q, price, 1000.0, np.full(n, 0.02), np.zeros(n))
    begin = time.process_time()
    for _ in range(20):
        simulate.growth_gradient(rng.normal(0, 0.1, n), *rest, 0.05)
    assert time.process_time() - begin < 1  # names by winners is 160 million logarithms


def test_backtest_trades_all_names_and_what_it_holds(spark):
    rows = [("b", 1, i, 0.02, 0.05 if i == 7 else 0.1, 1, 0) for i in range(10)]
    rows[7] = ("b", 1, 7, 0.005, 0.05, 1, 0)  # the best bet is the least likely of ten
    rows += [("b", 2, 10, 0.99, 1.0, 2, 0)]  # then only a name not worth its price has one
    days = spark.createDataFrame(rows, "book string, day int, name int, price double, prob double, snap int, won int")
    got = {(r.day, r.settled): r for r in simulate.backtest(days, book="book", day="day", name="name", price="price", prob="prob", snapshot="snap", won="won").collect()}
    assert got[1, False].n_open > 6
    assert got[2, False].traded > 0  # what is held has target 0


def test_fits_and_samples_take_the_whole_job(spark):
    from snapstride.plans import catalog, roles

    queries = catalog.queries()
    months = {str(r.snapshot_date)[5:7] for r in queries["pl_boosted_fit"](spark, "/root/testdata/sf0.01").collect()}
    assert len(months) == 12
    members = len(roles.scores(spark, "/root/testdata/sf0.001").first()["raw"])
    wins = np.array([r.p_win for r in queries["joint_samples"](spark, "/root/testdata/sf0.001").collect()]) * members
    assert np.allclose(wins * 200, np.round(wins * 200), atol=1e-6) and not np.allclose(wins * 50, np.round(wins * 50), atol=1e-6)
