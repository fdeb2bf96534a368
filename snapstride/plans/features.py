"""Admission and feature queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import asof, relative
from ..session import table
from . import roles
from .registry import query
from .roles import with_roles

SNAP = ["season", "snapshot_date"]
SNAP_DATE = ("snapshot_date",)
GATE = 0.9


def _r(c, n=6):
    return F.round(c, n)


def flagship(spark, sf, gate: float = 0.5):
    """Month-end admission by season-to-date level, then a share within the admitted."""
    box = roles.box_asof(roles.game_log(spark, sf)).withColumn("pct", relative.pool_rank("pts", SNAP))
    admitted = box.filter(F.col("pct") >= gate).withColumn("z", F.coalesce(relative.zscore("pts", SNAP), F.lit(0.0)))
    shares = admitted.withColumn("share", relative.softmax(F.col("z"), SNAP))
    return shares.select("season", "snapshot_date", "player_id", "gp", _r("pct").alias("pct"), _r("z").alias("z"), _r("share").alias("share"))


@query(
    "admission_share",
    with_roles("box", more="""ranked AS (SELECT *, percent_rank() OVER (PARTITION BY season, snapshot_date ORDER BY pts) AS pct FROM box),
  adm AS (SELECT *, coalesce((pts - avg(pts) OVER w) / nullif(stddev_pop(pts) OVER w, 0), 0) AS z FROM ranked WHERE pct >= 0.9
          WINDOW w AS (PARTITION BY season, snapshot_date))""")
    + """SELECT season, snapshot_date, player_id, gp, round(pct, 6) AS pct, round(z, 6) AS z,
  round(exp(z) / sum(exp(z)) OVER (PARTITION BY season, snapshot_date), 6) AS share FROM adm""",
    dates=SNAP_DATE,
)
def admission_share(spark, sf):
    return flagship(spark, sf, GATE)


@query(
    "asof_latest_team",
    with_roles("game_log", "grid", more="""keyed AS (SELECT DISTINCT player_id, season FROM game_log)""")
    + """SELECT k.player_id, s.season, s.snapshot_date, arg_max(p_brand, (game_date, l_orderkey, l_linenumber, g.l_partkey)) AS team
FROM keyed k JOIN grid s ON k.season = s.season
LEFT JOIN game_log g ON g.player_id = k.player_id AND g.season = s.season AND g.game_date <= s.snapshot_date
LEFT JOIN part ON g.l_partkey = p_partkey
GROUP BY k.player_id, s.season, s.snapshot_date""",
    dates=SNAP_DATE,
)
def asof_latest_team(spark, sf):
    log = roles.game_log(spark, sf)
    snaps = log.select("player_id", "season").distinct().join(F.broadcast(roles.grid(log).select(*SNAP)), "season").select("player_id", *SNAP)
    games = log.join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("team")), "l_partkey")
    return asof.latest(snaps, games, ["player_id", "season"], "snapshot_date", "game_date", ["l_orderkey", "l_linenumber", "l_partkey"], ["team"])


@query(
    "asof_prior_season_level",
    with_roles("box", more="ends AS (SELECT season, min(snapshot_date) AS d FROM grid WHERE kind = 'ratings' GROUP BY season)")
    + """SELECT b.player_id, b.season, b.snapshot_date, round(b.pts, 6) AS pts, round(p.pts, 6) AS prior_pts, p.gp AS prior_gp
FROM box b LEFT JOIN ends e ON e.season = b.season - 1
LEFT JOIN box p ON p.player_id = b.player_id AND p.season = b.season - 1 AND p.snapshot_date = e.d""",
    dates=SNAP_DATE,
)
def asof_prior_season_level(spark, sf):
    log = roles.game_log(spark, sf)
    box = roles.box_asof(log)
    ends = roles.grid(log).filter("kind = 'ratings'").groupBy("season").agg(F.min("snapshot_date").alias("snapshot_date"))
    prior = box.join(F.broadcast(ends), SNAP).select("player_id", (F.col("season") + 1).alias("season"), _r("pts").alias("prior_pts"), F.col("gp").alias("prior_gp"))
    return box.select("player_id", *SNAP, _r("pts").alias("pts")).join(prior, ["player_id", "season"], "left")


@query(
    "prior_win_count",
    with_roles("voting")
    + """SELECT player_id, season, award, CAST(greatest(0, coalesce(sum(won) OVER w, 0) - 1) AS BIGINT) AS repeat_wins,
  CAST(coalesce(sum(won) OVER w, 0) AS BIGINT) AS prior_wins FROM voting
WINDOW w AS (PARTITION BY player_id, award ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def prior_win_count(spark, sf):
    before = Window.partitionBy("player_id", "award").orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    wins = F.coalesce(F.sum("won").over(before), F.lit(0)).cast("long")
    rows = roles.award_voting(roles.game_log(spark, sf)).withColumn("prior_wins", wins)
    return rows.select("player_id", "season", "award", F.greatest(F.lit(0).cast("long"), F.col("prior_wins") - 1).alias("repeat_wins"), "prior_wins")


@query(
    "carry_label_selfjoin",
    with_roles("voting", more="totals AS (SELECT season, award, sum(votes) AS all_votes FROM voting GROUP BY season, award)")
    + """SELECT v.season, v.award, v.player_id, round(p.vote_share, 6) AS carry_share, p.rank AS carry_rank, p.won AS carry_won,
  CASE WHEN t.all_votes > 0 THEN round(v.votes / t.all_votes, 6) END AS first_place_share
FROM voting v LEFT JOIN voting p ON p.player_id = v.player_id AND p.award = v.award AND p.season = v.season - 1
LEFT JOIN totals t ON t.season = v.season AND t.award = v.award""",
)
def carry_label_selfjoin(spark, sf):
    votes = roles.award_voting(roles.game_log(spark, sf))
    prior = votes.select((F.col("season") + 1).alias("season"), "award", "player_id", _r("vote_share").alias("carry_share"), F.col("rank").cast("long").alias("carry_rank"), F.col("won").alias("carry_won"))
    total = F.sum("votes").over(Window.partitionBy("season", "award"))
    rows = votes.withColumn("first_place_share", F.when(total > 0, _r(F.col("votes") / total)))
    return rows.select("season", "award", "player_id", "first_place_share").join(prior, ["season", "award", "player_id"], "left")


@query(
    "pool_percent_rank",
    with_roles("box", more="axes AS (SELECT *, CASE WHEN gp >= 5 THEN mpg END AS axis_b FROM box)")
    + """SELECT player_id, season, snapshot_date, round(pa, 6) AS axis_a_pct, round(pb, 6) AS axis_b_pct,
  CAST(pa >= 0.9 OR (axis_b IS NOT NULL AND pb >= 0.9) AS INT) AS admitted
FROM (SELECT *, percent_rank() OVER (PARTITION BY season, snapshot_date ORDER BY pts NULLS FIRST) AS pa,
             percent_rank() OVER (PARTITION BY season, snapshot_date ORDER BY axis_b NULLS FIRST) AS pb FROM axes)""",
    dates=SNAP_DATE,
)
def pool_percent_rank(spark, sf):
    box = roles.box_asof(roles.game_log(spark, sf)).withColumn("axis_b", F.when(F.col("gp") >= 5, F.col("mpg")))
    rows = box.withColumn("pa", relative.pool_rank("pts", SNAP)).withColumn("pb", relative.pool_rank("axis_b", SNAP))
    gate = (F.col("pa") >= GATE) | (F.col("axis_b").isNotNull() & (F.col("pb") >= GATE))
    return rows.select("player_id", *SNAP, _r("pa").alias("axis_a_pct"), _r("pb").alias("axis_b_pct"), gate.cast("int").alias("admitted"))


@query(
    "group_percent_rank_nulls_out",
    with_roles("box", more="axes AS (SELECT *, CASE WHEN gp >= 5 THEN mpg END AS x FROM box)")
    + """SELECT player_id, season, snapshot_date, CASE WHEN x IS NOT NULL THEN
  round(percent_rank() OVER (PARTITION BY season, snapshot_date, x IS NULL ORDER BY x), 6) END AS pct FROM axes""",
    dates=SNAP_DATE,
)
def group_percent_rank_nulls_out(spark, sf):
    box = roles.box_asof(roles.game_log(spark, sf)).withColumn("x", F.when(F.col("gp") >= 5, F.col("mpg")))
    return box.select("player_id", *SNAP, _r(relative.member_rank("x", SNAP)).alias("pct"))


@query(
    "group_zscore",
    with_roles("box")
    + """SELECT player_id, season, snapshot_date, round((pts - avg(pts) OVER w) / nullif(stddev_pop(pts) OVER w, 0), 6) AS z_pts,
  round((mpg - avg(mpg) OVER w) / nullif(stddev_pop(mpg) OVER w, 0), 6) AS z_mpg,
  round((gp - avg(gp) OVER w) / nullif(stddev_pop(gp) OVER w, 0), 6) AS z_gp
FROM box WINDOW w AS (PARTITION BY season, snapshot_date)""",
    dates=SNAP_DATE,
)
def group_zscore(spark, sf):
    box = roles.box_asof(roles.game_log(spark, sf))
    return box.select("player_id", *SNAP, *[_r(relative.zscore(c, SNAP)).alias(f"z_{c}") for c in ("pts", "mpg", "gp")])


@query(
    "positional_zscore",
    with_roles("box", "player", more="""pool AS (SELECT b.*, position FROM box b JOIN player USING (player_id) WHERE gp >= 3),
  stats AS (SELECT season, snapshot_date, position, avg(pts) AS m, stddev_pop(pts) AS sd, count(*) AS n FROM pool GROUP BY 1, 2, 3)""")
    + """SELECT b.player_id, b.season, b.snapshot_date, CASE WHEN n >= 5 THEN round((b.pts - m) / nullif(sd, 0), 6) END AS z,
  CAST(p.position = 'ASIA' AS INT) AS is_asia, CAST(p.position = 'EUROPE' AS INT) AS is_europe
FROM box b LEFT JOIN player p USING (player_id)
LEFT JOIN stats s ON s.season = b.season AND s.snapshot_date = b.snapshot_date AND s.position = p.position""",
    dates=SNAP_DATE,
)
def positional_zscore(spark, sf):
    rows = roles.box_asof(roles.game_log(spark, sf)).join(roles.player(spark, sf), "player_id", "left")
    pool = rows.filter("gp >= 3 and position is not null").groupBy(*SNAP, "position").agg(F.avg("pts").alias("m"), F.stddev_pop("pts").alias("sd"), F.count(F.lit(1)).alias("n"))
    z = F.when(F.col("n") >= 5, _r((F.col("pts") - F.col("m")) / F.nullif(F.col("sd"), F.lit(0.0))))
    flags = [(F.col("position") == p.upper()).cast("int").alias(f"is_{p}") for p in ("asia", "europe")]
    return rows.join(pool, [*SNAP, "position"], "left").select("player_id", *SNAP, z.alias("z"), *flags)


@query(
    "closeness_entropy",
    with_roles("box", more="""zs AS (SELECT *, (pts - avg(pts) OVER w) AS d, stddev_pop(pts) OVER w AS sd, count(*) OVER w AS n FROM box
    WINDOW w AS (PARTITION BY season, snapshot_date)),
  ps AS (SELECT *, exp(CASE WHEN sd = 0 THEN 0 ELSE greatest(-10, least(10, d / sd)) END) AS e FROM zs),
  sh AS (SELECT *, e / sum(e) OVER (PARTITION BY season, snapshot_date) AS p FROM ps)""")
    + """SELECT s.season, s.snapshot_date, CASE WHEN max(n) >= 2 THEN round(-sum(p * ln(p)) / ln(max(n)), 6) END AS entropy,
  round(max(g.week_index) / nullif(max(m.most), 0), 6) AS frac
FROM sh s JOIN grid g ON g.season = s.season AND g.snapshot_date = s.snapshot_date
JOIN (SELECT season, max(week_index) AS most FROM grid WHERE week_index >= 0 GROUP BY season) m ON m.season = s.season
GROUP BY s.season, s.snapshot_date""",
    dates=SNAP_DATE,
)
def closeness_entropy(spark, sf):
    log = roles.game_log(spark, sf)
    w = Window.partitionBy(*SNAP)
    box = roles.box_asof(log).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("z", F.coalesce(relative.zscore("pts", SNAP), F.lit(0.0)))
    rows = box.withColumn("p", relative.softmax(F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.col("z"))), SNAP))
    shares = rows.groupBy(*SNAP).agg(F.when(F.max("n") >= 2, _r(-F.sum(F.col("p") * F.ln("p")) / F.nullif(F.ln(F.max("n")), F.lit(0.0)))).alias("entropy"))
    most = F.max(F.when(F.col("week_index") >= 0, F.col("week_index"))).over(Window.partitionBy("season"))
    frac = roles.grid(log).select(*SNAP, _r(F.col("week_index") / F.nullif(most, F.lit(0))).alias("frac"))
    return shares.join(F.broadcast(frac), SNAP)


@query(
    "season_delta",
    with_roles("box", more="ends AS (SELECT b.* FROM box b JOIN grid g ON g.season = b.season AND g.snapshot_date = b.snapshot_date AND g.kind = 'ratings')")
    + """SELECT c.player_id, c.season, round(c.pts - p.pts, 6) AS pts_d1, round(c.mpg - p.mpg, 6) AS mpg_d1, c.gp - p.gp AS gp_d1
FROM ends c LEFT JOIN ends p ON p.player_id = c.player_id AND p.season = c.season - 1""",
)
def season_delta(spark, sf):
    log = roles.game_log(spark, sf)
    ends = roles.box_asof(log).join(F.broadcast(roles.grid(log).filter("kind = 'ratings'").select(*SNAP)), SNAP)
    prior = ends.select("player_id", (F.col("season") + 1).alias("season"), *[F.col(c).alias(f"p_{c}") for c in ("pts", "mpg", "gp")])
    rows = ends.join(prior, ["player_id", "season"], "left")
    return rows.select("player_id", "season", *[_r(F.col(c) - F.col(f"p_{c}")).alias(f"{c}_d1") for c in ("pts", "mpg")], (F.col("gp") - F.col("p_gp")).alias("gp_d1"))


def _production(spark, sf):
    box = roles.box_asof(roles.game_log(spark, sf)).withColumn("pct", relative.pool_rank("pts", SNAP))
    return box.filter(F.col("pct") >= GATE).select("player_id", *SNAP)


def _carry_in(spark, sf):
    """Players with any share of last season's awards, at every snapshot not yet admitted."""
    log = roles.game_log(spark, sf)
    last = roles.award_voting(log).filter("vote_share > 0").select("player_id", (F.col("season") + 1).alias("season")).distinct()
    spots = last.join(F.broadcast(roles.grid(log).select(*SNAP)), "season").select("player_id", *SNAP)
    return spots.join(_production(spark, sf), ["player_id", *SNAP], "left_anti")


_ADMIT = """ranked AS (SELECT *, percent_rank() OVER (PARTITION BY season, snapshot_date ORDER BY pts) AS pct FROM box),
  production AS (SELECT player_id, season, snapshot_date FROM ranked WHERE pct >= 0.9),
  lasts AS (SELECT DISTINCT player_id, season + 1 AS season FROM voting WHERE vote_share > 0),
  carry AS (SELECT l.player_id, g.season, g.snapshot_date FROM lasts l JOIN grid g ON g.season = l.season
            WHERE NOT EXISTS (SELECT 1 FROM production p WHERE p.player_id = l.player_id AND p.season = g.season AND p.snapshot_date = g.snapshot_date))"""


@query("carryin_admission", with_roles("box", "voting", more=_ADMIT) + "SELECT * FROM carry", dates=SNAP_DATE)
def carryin_admission(spark, sf):
    return _carry_in(spark, sf)


@query(
    "forward_stick",
    with_roles("box", "voting", more=_ADMIT + """,
  firsts AS (SELECT player_id, season, min(snapshot_date) AS d FROM production GROUP BY 1, 2),
  stick AS (SELECT f.player_id, g.season, g.snapshot_date FROM firsts f JOIN grid g ON g.season = f.season AND g.snapshot_date > f.d
            WHERE NOT EXISTS (SELECT 1 FROM production p WHERE p.player_id = f.player_id AND p.season = g.season AND p.snapshot_date = g.snapshot_date)
              AND NOT EXISTS (SELECT 1 FROM carry c WHERE c.player_id = f.player_id AND c.season = g.season AND c.snapshot_date = g.snapshot_date))""")
    + """SELECT *, 1 AS limb_production, 0 AS limb_carryin, 0 AS limb_sticky FROM production
UNION ALL SELECT *, 0, 1, 0 FROM carry UNION ALL SELECT *, 0, 0, 1 FROM stick""",
    dates=SNAP_DATE,
)
def forward_stick(spark, sf):
    log = roles.game_log(spark, sf)
    key = ["player_id", *SNAP]
    production, carry = _production(spark, sf), _carry_in(spark, sf)
    firsts = production.groupBy("player_id", "season").agg(F.min("snapshot_date").alias("first"))
    later = firsts.join(F.broadcast(roles.grid(log).select(*SNAP)), "season").filter("snapshot_date > first").select(*key)
    stick = later.join(production.unionByName(carry), key, "left_anti")
    limbs = ("limb_production", "limb_carryin", "limb_sticky")
    marked = [df.select(*key, *[F.lit(int(i == j)).alias(n) for j, n in enumerate(limbs)]) for i, df in enumerate((production, carry, stick))]
    return marked[0].unionByName(marked[1]).unionByName(marked[2])


@query(
    "rookie_pool",
    """WITH firsts AS (SELECT o_custkey, CAST(min(year(o_orderdate)) AS INT) AS season FROM orders GROUP BY 1)
SELECT f.season, c.c_custkey AS player_id, c.c_mktsegment AS segment FROM firsts f JOIN customer c ON c.c_custkey = f.o_custkey
WHERE c.c_acctbal IS NULL OR c.c_acctbal <= 5000""",
)
def rookie_pool(spark, sf):
    firsts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("player_id")).agg(F.min(F.year("o_orderdate")).alias("season"))
    who = table(spark, sf, "customer").filter("c_acctbal is null or c_acctbal <= 5000").select(F.col("c_custkey").alias("player_id"), F.col("c_mktsegment").alias("segment"))
    return firsts.join(who, "player_id")


@query(
    "identity_gap",
    """SELECT CAST(year(o_orderdate) AS INT) AS season, count(*) AS unresolved, count(DISTINCT o_custkey) AS ids
FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment <> 'MACHINERY') GROUP BY 1""",
)
def identity_gap(spark, sf):
    known = table(spark, sf, "customer").filter("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    lost = table(spark, sf, "orders").join(known, "o_custkey", "left_anti")
    return lost.groupBy(F.year("o_orderdate").alias("season")).agg(F.count(F.lit(1)).alias("unresolved"), F.count_distinct("o_custkey").alias("ids"))


@query(
    "star_feature_table",
    with_roles("box", "voting", "player", more=_ADMIT + """,
  shares AS (SELECT player_id, season, max(vote_share) AS best_share, sum(won) AS wins FROM voting GROUP BY 1, 2),
  ends AS (SELECT b.* FROM box b JOIN grid g ON g.season = b.season AND g.snapshot_date = b.snapshot_date AND g.kind = 'ratings')""")
    + """SELECT a.player_id, a.season, a.snapshot_date, g.week_index, pl.position, b.gp, round(b.pts, 6) AS pts, round(b.mpg, 6) AS mpg,
  round(e.pts, 6) AS prior_pts, round(s.best_share, 6) AS label_share, round(c.best_share, 6) AS carry_share, CAST(c.wins AS BIGINT) AS carry_wins
FROM (SELECT * FROM production UNION ALL SELECT * FROM carry) a
JOIN grid g ON g.season = a.season AND g.snapshot_date = a.snapshot_date
LEFT JOIN player pl ON pl.player_id = a.player_id
LEFT JOIN box b ON b.player_id = a.player_id AND b.season = a.season AND b.snapshot_date = a.snapshot_date
LEFT JOIN ends e ON e.player_id = a.player_id AND e.season = a.season - 1
LEFT JOIN shares s ON s.player_id = a.player_id AND s.season = a.season
LEFT JOIN shares c ON c.player_id = a.player_id AND c.season = a.season - 1""",
    dates=SNAP_DATE,
)
def star_feature_table(spark, sf):
    log = roles.game_log(spark, sf)
    box, grid = roles.box_asof(log), F.broadcast(roles.grid(log))
    shares = roles.award_voting(log).groupBy("player_id", "season").agg(F.max("vote_share").alias("best"), F.sum("won").cast("long").alias("wins"))
    admitted = _production(spark, sf).unionByName(_carry_in(spark, sf))
    ends = box.join(grid.filter("kind = 'ratings'").select(*SNAP), SNAP).select("player_id", (F.col("season") + 1).alias("season"), _r("pts").alias("prior_pts"))
    key = ["player_id", "season"]
    rows = admitted.join(grid.select(*SNAP, "week_index"), SNAP).join(roles.player(spark, sf).select("player_id", "position"), "player_id", "left")
    rows = rows.join(box.select("player_id", *SNAP, "gp", _r("pts").alias("pts"), _r("mpg").alias("mpg")), ["player_id", *SNAP], "left")
    rows = rows.join(ends, key, "left").join(shares.select(*key, _r("best").alias("label_share")), key, "left")
    carried = shares.select("player_id", (F.col("season") + 1).alias("season"), _r("best").alias("carry_share"), F.col("wins").alias("carry_wins"))
    return rows.join(carried, key, "left").select("player_id", *SNAP, "week_index", "position", "gp", "pts", "mpg", "prior_pts", "label_share", "carry_share", "carry_wins")


@query(
    "renormalised_vote_share",
    with_roles("voting", more="""cut AS (SELECT season, award, player_id, CASE WHEN rank <= 5 THEN vote_share END AS s FROM voting),
  tot AS (SELECT *, sum(s) OVER (PARTITION BY season, award) AS t FROM cut)""")
    + "SELECT season, award, player_id, round(CASE WHEN t > 0 AND abs(t - 1) > 1e-6 THEN s / t ELSE s END, 6) AS vote_share FROM tot",
)
def renormalised_vote_share(spark, sf):
    rows = roles.award_voting(roles.game_log(spark, sf)).withColumn("s", F.when(F.col("rank") <= 5, F.col("vote_share")))
    t = F.sum("s").over(Window.partitionBy("season", "award"))
    share = F.when((t > 0) & (F.abs(t - 1) > 1e-6), F.col("s") / F.nullif(t, F.lit(0.0))).otherwise(F.col("s"))
    return rows.select("season", "award", "player_id", _r(share).alias("vote_share"))


@query(
    "label_sum_diagnostic",
    with_roles("voting", more="sums AS (SELECT season, award, sum(CASE WHEN rank <= 5 THEN vote_share ELSE 0 END) AS s FROM voting GROUP BY 1, 2)")
    + """SELECT award, round(avg(s), 6) AS mean, round(min(s), 6) AS least, round(quantile_cont(s, 0.05), 6) AS p5,
  count(*) FILTER (WHERE s < 0.5) AS below_half, count(*) FILTER (WHERE s = 0) AS zero FROM sums GROUP BY award""",
)
def label_sum_diagnostic(spark, sf):
    rows = roles.award_voting(roles.game_log(spark, sf))
    sums = rows.groupBy("season", "award").agg(F.sum(F.when(F.col("rank") <= 5, F.col("vote_share")).otherwise(0.0)).alias("s"))
    return sums.groupBy("award").agg(
        _r(F.avg("s")).alias("mean"), _r(F.min("s")).alias("least"), _r(F.percentile("s", F.lit(0.05))).alias("p5"), F.count_if(F.col("s") < 0.5).alias("below_half"), F.count_if(F.col("s") == 0).alias("zero")
    )


@query(
    "one_winner_check",
    with_roles("voting") + "SELECT season, award, CAST(sum(won) AS BIGINT) AS winners, sum(won) = 1 AS good FROM voting GROUP BY 1, 2",
)
def one_winner_check(spark, sf):
    rows = roles.award_voting(roles.game_log(spark, sf)).groupBy("season", "award").agg(F.sum("won").cast("long").alias("winners"))
    return rows.withColumn("good", F.col("winners") == 1)


@query(
    "walk_forward_folds",
    with_roles("game_log", more="s AS (SELECT DISTINCT season FROM game_log)")
    + """SELECT t.season AS held_out, count(*) AS train_seasons, max(e.season) AS train_le
FROM s t JOIN s e ON e.season < t.season GROUP BY 1 HAVING count(*) >= 5""",
)
def walk_forward_folds(spark, sf):
    seasons = roles.game_log(spark, sf).select("season").distinct()
    earlier = F.row_number().over(Window.orderBy("season")) - 1
    rows = seasons.select(F.col("season").alias("held_out"), earlier.cast("long").alias("train_seasons"), F.lag("season").over(Window.orderBy("season")).alias("train_le"))
    return rows.filter("train_seasons >= 5")


@query(
    "season_fraction_interp",
    with_roles("game_log", "grid", more="""frac AS (SELECT season, snapshot_date, week_index / max(week_index) OVER (PARTITION BY season)::DOUBLE AS f FROM grid),
  days AS (SELECT DISTINCT season, game_date AS day FROM game_log),
  near AS (SELECT d.season, d.day, max(f.snapshot_date) FILTER (WHERE f.snapshot_date <= d.day) AS x0, min(f.snapshot_date) FILTER (WHERE f.snapshot_date >= d.day) AS x1
           FROM days d JOIN frac f USING (season) GROUP BY 1, 2)""")
    + """SELECT n.season, n.day, round(CASE WHEN x0 IS NULL THEN b.f WHEN x1 IS NULL OR x0 = x1 THEN a.f
  ELSE a.f + (b.f - a.f) * date_diff('day', x0, n.day) / date_diff('day', x0, x1) END, 6) AS frac
FROM near n LEFT JOIN frac a ON a.season = n.season AND a.snapshot_date = x0 LEFT JOIN frac b ON b.season = n.season AND b.snapshot_date = x1""",
    dates=("day",),
)
def season_fraction_interp(spark, sf):
    log = roles.game_log(spark, sf)
    most = F.max("week_index").over(Window.partitionBy("season"))
    known = roles.grid(log).select("season", F.col("snapshot_date").alias("day"), (F.col("week_index") / F.nullif(most, F.lit(0))).alias("f"))
    days = log.select("season", F.col("game_date").alias("day")).distinct().withColumn("wanted", F.lit(True))
    rows = days.join(F.broadcast(known), ["season", "day"], "full")
    point = F.when(F.col("f").isNotNull(), F.struct(F.unix_date("day").alias("x"), F.col("f").alias("y")))
    by = Window.partitionBy("season").orderBy("day")
    a = F.last(point, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    b = F.first(point, ignorenulls=True).over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("a", a).withColumn("b", b).filter("wanted")
    frac = asof.interpolate(F.unix_date("day"), F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"))
    return rows.select("season", "day", _r(frac).alias("frac"))


@query(
    "forward_noise_regression",
    with_roles("box", more="""fin AS (SELECT player_id, season, arg_max(pts, snapshot_date) AS last_pts FROM box GROUP BY 1, 2),
  err AS (SELECT b.season, ln(b.pts / f.last_pts) AS e, (month(b.snapshot_date) - 1) / 11e0 AS frac FROM box b JOIN fin f USING (player_id, season)),
  bins AS (SELECT greatest(1, ceil(frac * 10)) AS bin, var_pop(e) AS v, count(*) AS n FROM err GROUP BY 1),
  pts AS (SELECT (bin - 0.5) / 10 AS x, ln(0.5 * v) AS y, n FROM bins WHERE (bin - 0.5) / 10 <= 0.6 AND v > 0)""")
    + "SELECT count(*) AS bins, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM pts",
)
def forward_noise_regression(spark, sf):
    box = roles.box_asof(roles.game_log(spark, sf))
    last = F.last("pts").over(Window.partitionBy("player_id", "season").orderBy("snapshot_date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = box.select(F.ln(F.col("pts") / last).alias("e"), ((F.month("snapshot_date") - 1) / 11.0).alias("frac"))
    bins = rows.groupBy(F.greatest(F.lit(1), F.ceil(F.col("frac") * 10)).alias("bin")).agg(F.var_pop("e").alias("v"))
    points = bins.select(((F.col("bin") - 0.5) / 10).alias("x"), F.col("v")).filter("x <= 0.6 and v > 0").withColumn("y", F.ln(F.col("v") * 0.5))
    return points.agg(F.count(F.lit(1)).alias("bins"), _r(F.regr_slope("y", "x")).alias("slope"), _r(F.regr_intercept("y", "x")).alias("intercept"))
