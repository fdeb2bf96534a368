"""Queries that SQL cannot express: fits, simulations and the daily fold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import model, relative, simulate
from ..session import shared_dir, ship
from . import ensembles, markets, roles, volatility
from .registry import query

SNAP = ["season", "snapshot_date"]


def _design(spark, sf):
    """Month-end rows with group-relative features and each candidate's season share as label."""
    log = roles.game_log(spark, sf)
    votes = roles.award_voting(log).filter("award = 'N'").select("player_id", "season", "vote_share", "votes")
    box = roles.box_asof(log).join(votes, ["player_id", "season"])
    label = F.col("vote_share") / F.sum("vote_share").over(Window.partitionBy(*SNAP))
    return box.select("player_id", *SNAP, *[relative.zscore(c, SNAP).alias(f"z_{c}") for c in ("pts", "mpg", "gp")], label.alias("label"), "vote_share", "votes")


@query("pl_ensemble_fit", dates=("snapshot_date",))
def pl_ensemble_fit(spark, sf):
    """Out-of-fold ensemble of the last snapshot of each season: mean score, spread, share."""
    ship(spark)
    rows = _design(spark, sf)
    scored = model.ensemble_scores(rows, keys=["player_id", *SNAP], season="season", group=SNAP, features=["z_pts", "z_mpg", "z_gp"], label="label")
    sums = scored.groupBy("player_id", *SNAP).agg(F.avg("score").alias("mu"), F.stddev_pop("score").alias("sigma"), F.count(F.lit(1)).alias("k"))
    return sums.withColumn("share", relative.softmax(F.col("mu"), SNAP))


@query("pl_boosted_fit", dates=("snapshot_date",))
def pl_boosted_fit(spark, sf):
    ship(spark)
    rows = _design(spark, sf).filter("z_pts is not null")
    scored = model.ensemble_scores(rows, keys=["player_id", *SNAP], season="season", group=SNAP, features=["z_pts", "z_mpg", "z_gp"], label="label", learner="trees")
    return scored.groupBy("player_id", *SNAP).agg(F.avg("score").alias("mu"))


@query("gain_importance")
def gain_importance(spark, sf):
    ship(spark)
    return model.gain_importance(_design(spark, sf).filter("z_pts is not null"), season="season", group=SNAP, features=["z_pts", "z_mpg", "z_gp"], label="label")


@query("retrain_arms")
def retrain_arms(spark, sf):
    """Linear ensembles of four arms: as they are, one sign held, by points' share and by first-place share."""
    ship(spark)
    rows = _design(spark, sf)
    w = Window.partitionBy(*SNAP)
    rows = rows.withColumn("first", F.coalesce(F.col("votes") / F.nullif(F.sum("votes").over(w), F.lit(0)), F.lit(0.0)))
    arms = {"baseline": ("label", {}), "monotone": ("label", {"z_gp": -1}), "vs": ("vote_share", {}), "fp": ("first", {})}
    return model.fit_arms(rows, arms, season="season", group=SNAP, features=["z_pts", "z_mpg", "z_gp"]).drop("features", "mean", "sd")


@query("joint_samples")
def joint_samples(spark, sf):
    ship(spark)
    rows = roles.scores(spark, sf).withColumn("frac", (F.col("grp") % 10) / 10.0)
    return simulate.joint_samples(rows, group=["grp"], key="candidate", raw="raw", frac="frac")


@query("bootstrap_win_ci")
def bootstrap_win_ci(spark, sf):
    """Interval of each candidate's win share over resampled ensemble members."""
    ship(spark)
    return simulate.bootstrap_wins(roles.scores(spark, sf), group=["grp"], key="candidate", raw="raw")


@query("garch_vol")
def garch_vol(spark, sf):
    ship(spark)
    return simulate.garch(markets._steps(spark, sf), "candidate", "i", "s")


@query("forward_edge")
def forward_edge(spark, sf):
    """Each candidate's forward edge at its last price, its moves drawn from all series around that point."""
    ship(spark)
    corpus = simulate.move_corpus(volatility._moves(spark, sf))
    last = markets._steps(spark, sf).groupBy("candidate").agg(F.max_by("price", "i").alias("price"), F.sqrt(F.avg(F.col("s") * F.col("s"))).alias("vol"))
    rows = last.select("candidate", "price", ((F.col("candidate") % 11) / 10.0).alias("frac"), "vol")
    return simulate.forward_edge(rows, corpus, key="candidate", price="price", frac="frac", vol="vol")


@query("kelly_backtest", dates=("day",))
def kelly_backtest(spark, sf):
    """Three books of candidates, priced on sealed days, solved and folded day by day."""
    ship(spark)
    prices = markets._grid_prices(spark, sf, 3, 4).select("candidate", "day", F.coalesce("fwd", "locf").alias("price")).filter("price is not null")
    shares = ensembles._shares(spark, sf).select("candidate", "vs", F.col("grp").alias("g"))
    rows = prices.join(shares, "candidate").withColumn("book", (F.col("g") % 3).cast("int"))
    rows = rows.withColumn("prob", F.col("vs") / F.sum("vs").over(Window.partitionBy("book", "day"))).withColumn("snapshot", F.date_trunc("week", "day"))
    winner = F.col("candidate") == F.min("candidate").over(Window.partitionBy("book"))
    return simulate.backtest(rows.withColumn("won", winner.cast("int")), book="book", day="day", name="candidate", price="price", prob="prob", snapshot="snapshot", won="won")


@query("score_from_models", dates=("snapshot_date",))
def score_from_models(spark, sf):
    """A model table fitted and written, then rows scored from it: mean, spread and share."""
    ship(spark)
    rows, features = _design(spark, sf), ["z_pts", "z_mpg", "z_gp"]
    path = shared_dir(spark, "models")
    model.fit_models(rows, season="season", group=SNAP, features=features, label="label").write.parquet(path)
    scored = model.score_with(rows, spark.read.schema(model.MODEL).parquet(path), season="season", features=features, keys=["player_id", *SNAP])
    sums = scored.groupBy("player_id", *SNAP).agg(F.avg("score").alias("mu"), F.stddev_pop("score").alias("sigma"))
    return sums.withColumn("share", relative.softmax(F.col("mu"), SNAP))


@query("glm_fit")
def glm_fit(spark, sf):
    """Weights of log reach on (1, x, x squared, log vol): Spark sums, a 4 x 4 ridge solve here."""
    s = markets.normal_sums(spark, sf).first()
    a = np.array([[s.n, s.xb, s.bb, s.xd], [s.xb, s.bb, s.bc, s.bd], [s.bb, s.bc, s.cc, s.cd], [s.xd, s.bd, s.cd, s.dd]], float)
    w = np.linalg.solve(a + 1e-3 * np.eye(4), np.array([s.xy, s.byy, s.cy, s.dy]))
    return spark.createDataFrame([(n, float(x)) for n, x in zip(("one", "logit", "logit2", "log_vol"), w, strict=True)], "term string, weight double")
