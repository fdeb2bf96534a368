"""The feature table and the design matrix, their columns generated by family."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relative
from ..session import table
from ..sources import tables
from . import availability, features, ingest, roles
from .registry import query
from .roles import with_roles

KEY = ["player_id", "season", "snapshot_date"]
SNAP = ["season", "snapshot_date"]
AWARD = "N"


def _r(c, n=6):
    return F.round(c, n)


#: What is summed over games, whole numbers so that sums are exact: Spark expression and SQL.
SUMS = {
    "pts": ("floor(l_extendedprice * (1 - l_discount))", "floor(l_extendedprice * (1 - l_discount))"),
    "mpg": ("l_quantity", "l_quantity"),
    "gross": ("floor(l_extendedprice)", "floor(l_extendedprice)"),
    "disc": ("round(l_discount * 100)", "round(l_discount * 100)"),
    "tax": ("round(l_tax * 100)", "round(l_tax * 100)"),
    "ret": ("if(l_returnflag = 'R', 1, 0)", "(l_returnflag = 'R')::INT"),
    "acc": ("if(l_returnflag = 'A', 1, 0)", "(l_returnflag = 'A')::INT"),
    "open": ("if(l_linestatus = 'O', 1, 0)", "(l_linestatus = 'O')::INT"),
}
#: Families of per-game levels, each in the trajectories of its kind.
FAMILIES = {"box": ["pts", "mpg"], "adv": ["gross", "disc", "tax"], "hus": ["ret", "acc"], "dfn": ["open"]}
TRAJECTORIES = {"box": ["std", "l3", "l3_vs_std"], "adv": ["std"], "hus": ["std", "l3_vs_std"], "dfn": ["std", "l3"]}
TEAM = ["team_gp", "team_pts_std", "team_win_pct", "team_conf_rank"]
AVAILABILITY = ["appeared", "qualifying"]
LABELS = ["label_vote_share", "label_rank", "label_won_flag"]
CARRIED = ["carry_vote_share", "carry_rank", "carry_won", "carry_honour_a", "carry_honour_r", "carry_years_repeat"]


def family_columns() -> list[str]:
    """box_pts_std and so on: each family's sums in each of its trajectories."""
    return [f"{f}_{s}_{t}" for f, names in FAMILIES.items() for s in names for t in TRAJECTORIES[f]]


def delta_columns() -> list[str]:
    """Levels that are compared with the end of the season before."""
    return [f"{f}_{s}_std" for f in ("box", "adv") for s in FAMILIES[f]] + ["team_pts_std", "team_win_pct", "team_conf_rank"]


def relative_columns() -> list[str]:
    return [*family_columns(), "team_pts_std", "team_win_pct", "team_conf_rank", *AVAILABILITY, *[f"{c}_d1" for c in delta_columns()], "carry_vote_share"]


def relative_kind(column: str) -> str:
    """``pct`` for heavy-tailed columns, ``z`` for others; a delta is as its parent."""
    if column.endswith("_d1"):
        return relative_kind(column[:-3])
    return "pct" if column.endswith("_l3_vs_std") or column.startswith("hus_") or column == "appeared" else "z"


def feature_columns() -> list[str]:
    return [*family_columns(), *TEAM, *AVAILABILITY, *LABELS, *CARRIED, *[f"prior_{c}" for c in delta_columns()]]


# ---- the same in SQL

_SO_FAR = "OVER (PARTITION BY {by} ORDER BY d ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"


def _trajectory_sql(s: str, t: str) -> str:
    std, l3 = (f"(sum(s_{s}) {w} / sum(n) {w})" for w in (_SO_FAR.format(by="player_id, season", n="UNBOUNDED"), _SO_FAR.format(by="player_id, season", n=2)))
    return {"std": std, "l3": l3, "l3_vs_std": f"({l3} / nullif({std}, 0))"}[t]


def _feature_sql() -> str:
    sums = ", ".join(f"sum({sql})::DOUBLE AS s_{s}" for s, (_, sql) in SUMS.items())
    form = ", ".join(f"{_trajectory_sql(s, t)} AS {f}_{s}_{t}" for f, names in FAMILIES.items() for s in names for t in TRAJECTORIES[f])
    team = _SO_FAR.format(by="team_id, season", n="UNBOUNDED")
    levels = ", ".join(f"f.{c}" for c in family_columns())
    prior = ", ".join(f"{'p' if c.startswith(('box', 'adv')) else 'pt' if c == 'team_pts_std' else 'pr'}.{c} AS prior_{c}" for c in delta_columns())
    return f"""admitted AS (SELECT * FROM production UNION ALL SELECT * FROM carry),
  months AS (SELECT l_suppkey AS player_id, CAST(year(CAST(l_shipdate AS DATE)) AS INT) AS season, last_day(CAST(l_shipdate AS DATE)) AS d, count(*) AS n, {sums} FROM lineitem GROUP BY 1, 2, 3),
  spots AS (SELECT p.player_id, g.season, g.snapshot_date AS d FROM (SELECT DISTINCT player_id, season FROM months) p JOIN grid g ON g.season = p.season),
  filled AS (SELECT s.player_id, s.season, s.d, m.* EXCLUDE (player_id, season, d) FROM spots s LEFT JOIN months m ON m.player_id = s.player_id AND m.season = s.season AND m.d = s.d),
  form AS (SELECT player_id, season, d AS snapshot_date, {form} FROM filled),
  tmonths AS (SELECT s_nationkey AS team_id, season, d, sum(n) AS n, sum(s_pts) AS s_pts FROM months JOIN supplier ON s_suppkey = player_id GROUP BY 1, 2, 3),
  tspots AS (SELECT t.team_id, g.season, g.snapshot_date AS d FROM (SELECT DISTINCT team_id, season FROM tmonths) t JOIN grid g ON g.season = t.season),
  team AS (SELECT t.team_id, t.season, t.d AS snapshot_date, CAST(sum(n) {team.replace('team_id, season', 't.team_id, t.season').replace('ORDER BY d', 'ORDER BY t.d')} AS BIGINT) AS team_gp, sum(s_pts) {team.replace('team_id, season', 't.team_id, t.season').replace('ORDER BY d', 'ORDER BY t.d')} / sum(n) {team.replace('team_id, season', 't.team_id, t.season').replace('ORDER BY d', 'ORDER BY t.d')} AS team_pts_std
    FROM tspots t LEFT JOIN tmonths m ON m.team_id = t.team_id AND m.season = t.season AND m.d = t.d),
  records AS (SELECT team_id, season, wins / (wins + losses) AS team_win_pct, rank() OVER (PARTITION BY season, n_regionkey ORDER BY wins / (wins + losses) DESC) AS team_conf_rank
    FROM (SELECT c_nationkey AS team_id, CAST(year(o_orderdate) AS INT) AS season, count(*) FILTER (WHERE o_orderstatus = 'F') AS wins, count(*) FILTER (WHERE o_orderstatus <> 'F') AS losses FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) JOIN nation ON n_nationkey = team_id),
  avail AS (SELECT player_id, season, snapshot_date, appeared, n_full + least(2, n_near) AS qualifying FROM q WHERE appeared > 0),
  votes AS (SELECT * FROM voting WHERE award = '{AWARD}'),
  repeats AS (SELECT v.player_id, s.season, greatest(0, count(*) - 1) AS carry_years_repeat FROM votes v JOIN (SELECT DISTINCT season FROM grid) s ON v.season < s.season WHERE v.won = 1 GROUP BY 1, 2),
  ends AS (SELECT season, min(snapshot_date) AS d FROM grid WHERE kind = 'ratings' GROUP BY 1),
  star AS (SELECT a.player_id, a.season, a.snapshot_date, g.week_index, pl.position, {levels}, t.team_gp, t.team_pts_std, r.team_win_pct, r.team_conf_rank, av.appeared, av.qualifying,
      v.vote_share AS label_vote_share, v.rank AS label_rank, v.won AS label_won_flag, c.vote_share AS carry_vote_share, c.rank AS carry_rank, c.won AS carry_won,
      CAST(ha.rank <= 3 AS INT) AS carry_honour_a, CAST(hr.rank <= 3 AS INT) AS carry_honour_r, coalesce(rp.carry_years_repeat, 0) AS carry_years_repeat, {prior}
    FROM admitted a JOIN player pl ON pl.player_id = a.player_id JOIN supplier su ON su.s_suppkey = a.player_id JOIN grid g ON g.season = a.season AND g.snapshot_date = a.snapshot_date
    LEFT JOIN form f ON f.player_id = a.player_id AND f.season = a.season AND f.snapshot_date = a.snapshot_date
    LEFT JOIN team t ON t.team_id = su.s_nationkey AND t.season = a.season AND t.snapshot_date = a.snapshot_date
    LEFT JOIN records r ON r.team_id = su.s_nationkey AND r.season = a.season
    LEFT JOIN avail av ON av.player_id = a.player_id AND av.season = a.season AND av.snapshot_date = a.snapshot_date
    LEFT JOIN votes v ON v.player_id = a.player_id AND v.season = a.season
    LEFT JOIN votes c ON c.player_id = a.player_id AND c.season = a.season - 1
    LEFT JOIN voting ha ON ha.award = 'A' AND ha.player_id = a.player_id AND ha.season = a.season - 1
    LEFT JOIN voting hr ON hr.award = 'R' AND hr.player_id = a.player_id AND hr.season = a.season - 1
    LEFT JOIN repeats rp ON rp.player_id = a.player_id AND rp.season = a.season
    LEFT JOIN ends e ON e.season = a.season - 1
    LEFT JOIN form p ON p.player_id = a.player_id AND p.season = a.season - 1 AND p.snapshot_date = e.d
    LEFT JOIN team pt ON pt.team_id = su.s_nationkey AND pt.season = a.season - 1 AND pt.snapshot_date = e.d
    LEFT JOIN records pr ON pr.team_id = su.s_nationkey AND pr.season = a.season - 1)"""


def _rounded_sql(columns: list[str]) -> str:
    whole = {"team_gp", "team_conf_rank", "prior_team_conf_rank", "appeared", "qualifying", "label_rank", "label_won_flag", "carry_rank", "carry_won", "carry_honour_a", "carry_honour_r", "carry_years_repeat"}
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" if c in whole else f"round({c}, 6) AS {c}" for c in columns)


def _rounded(columns: list[str], rows):
    return [_r(c).alias(c) if dict(rows.dtypes)[c] == "double" else F.col(c).cast("long").alias(c) for c in columns]


_STAR = with_roles("box", "voting", "player", more=features._ADMIT + ", " + availability._QUAL + ", " + _feature_sql())


def _form(spark, sf):
    """All families of levels at every snapshot, by running sums over months: one window, no join of families."""
    day = F.to_date("l_shipdate")
    log = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("player_id"), F.year(day).alias("season"), F.last_day(day).alias("snapshot_date"), *[F.expr(e).cast("double").alias(f"s_{s}") for s, (e, _) in SUMS.items()])
    months = log.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"s_{s}").alias(f"s_{s}") for s in SUMS])
    grid = log.select(*SNAP).distinct()
    spots = months.select("player_id", "season").distinct().join(F.broadcast(grid), "season")  # a row a month
    filled = spots.join(months, KEY, "left")
    run = Window.partitionBy("player_id", "season").orderBy("snapshot_date")
    so_far, three = run.rowsBetween(Window.unboundedPreceding, Window.currentRow), run.rowsBetween(-2, Window.currentRow)

    def level(s: str, t: str):
        std, l3 = (F.sum(f"s_{s}").over(w) / F.sum("n").over(w) for w in (so_far, three))
        return {"std": std, "l3": l3, "l3_vs_std": l3 / F.nullif(std, F.lit(0.0))}[t]

    return months, grid, filled.select(*KEY, *[level(s, t).alias(f"{f}_{s}_{t}") for f, names in FAMILIES.items() for s in names for t in TRAJECTORIES[f]])


def _team(spark, sf, months, grid):
    of = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("player_id"), F.col("s_nationkey").alias("team_id"))
    key = ["team_id", *SNAP]
    sums = months.join(of, "player_id").groupBy(*key).agg(F.sum("n").alias("n"), F.sum("s_pts").alias("s_pts"))
    filled = sums.select("team_id", "season").distinct().join(F.broadcast(grid), "season").join(sums, key, "left")
    so_far = Window.partitionBy("team_id", "season").orderBy("snapshot_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.sum("n").over(so_far)
    return filled.select(*key, n.alias("team_gp"), (F.sum("s_pts").over(so_far) / n).alias("team_pts_std"))


def _records(spark, sf):
    rows = ingest.team_record_build(spark, sf)
    return rows.select("team_id", "season", (F.col("wins") / (F.col("wins") + F.col("losses"))).alias("team_win_pct"), F.col("conf_rank").alias("team_conf_rank"))


def star(spark, sf):
    """Each admitted (player, season, snapshot) with every family, team, label, carried and prior column."""
    log = roles.game_log(spark, sf)
    months, grid, form = _form(spark, sf)
    team, records = _team(spark, sf, months, grid), _records(spark, sf)
    season = ["player_id", "season"]
    snaps = roles.grid(log)
    who = roles.player(spark, sf).select("player_id", "position").join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("player_id"), F.col("s_nationkey").alias("team_id")), "player_id")
    voting = roles.award_voting(log)
    votes = voting.filter(F.col("award") == AWARD)
    own = {"vote_share": "vote_share", "rank": "rank", "won": "won_flag"}
    label = votes.select(*season, *[F.col(a).alias(f"label_{b}") for a, b in own.items()])
    later = (F.col("season") + 1).alias("season")
    carry = votes.select("player_id", later, F.col("vote_share").alias("carry_vote_share"), F.col("rank").alias("carry_rank"), F.col("won").alias("carry_won"))
    honours = [voting.filter(F.col("award") == a.upper()).select("player_id", later, (F.col("rank") <= 3).cast("int").alias(f"carry_honour_{a}")) for a in "ar"]
    seasons = F.broadcast(snaps.select("season").distinct().withColumnRenamed("season", "now"))  # a row a season
    repeats = votes.filter("won = 1").join(seasons, F.col("season") < F.col("now")).groupBy("player_id", F.col("now").alias("season")).agg(F.greatest(F.lit(0), F.count(F.lit(1)) - 1).alias("carry_years_repeat"))
    avail = availability._qualifying(spark, sf).select(*KEY, "appeared", (F.col("n_full") + F.least(F.lit(2).cast("long"), F.col("n_near"))).alias("qualifying"))
    ends = F.broadcast(snaps.filter("kind = 'ratings'").groupBy("season").agg(F.min("snapshot_date").alias("snapshot_date")))

    def prior(rows, key: str, columns: list[str]):
        return rows.select(key, later, *[F.col(c).alias(f"prior_{c}") for c in columns])

    rows = features._production(spark, sf).unionByName(features._carry_in(spark, sf)).join(who, "player_id")
    rows = rows.join(F.broadcast(snaps.select(*SNAP, "week_index")), SNAP).join(form, KEY, "left").join(avail, KEY, "left")
    rows = rows.join(team, ["team_id", *SNAP], "left").join(records, ["team_id", "season"], "left")
    by_season = [label, carry, *honours, repeats, prior(form.join(ends, SNAP), "player_id", [c for c in delta_columns() if not c.startswith("team")])]
    rows = reduce(lambda a, b: a.join(b, season, "left"), by_season, rows)
    by_team = [prior(team.join(ends, SNAP), "team_id", ["team_pts_std"]), prior(records, "team_id", ["team_win_pct", "team_conf_rank"])]
    rows = reduce(lambda a, b: a.join(b, ["team_id", "season"], "left"), by_team, rows)
    return rows.withColumn("carry_years_repeat", F.coalesce("carry_years_repeat", F.lit(0))).select(*KEY, "week_index", "position", *feature_columns())


@query("feature_table", _STAR + f"SELECT player_id, season, snapshot_date, week_index, position, {_rounded_sql(feature_columns())} FROM star", dates=("snapshot_date",))
def feature_table(spark, sf):
    rows = star(spark, sf)
    return rows.select(*KEY, "week_index", "position", *_rounded(feature_columns(), rows))


def _relative_sql(c: str) -> str:
    if relative_kind(c) == "pct":
        return f"CASE WHEN {c} IS NOT NULL THEN percent_rank() OVER (PARTITION BY season, snapshot_date, {c} IS NULL ORDER BY {c}) END"
    return f"({c} - avg({c}) OVER g) / nullif(stddev_pop({c}) OVER g, 0)"


_POSITIONAL = ["box_pts_std", "box_mpg_std", "adv_gross_std"]
_DESIGN = (
    _STAR.rstrip()
    + ", deltas AS (SELECT *, "
    + ", ".join(f"{c} - prior_{c} AS {c}_d1" for c in delta_columns())
    + " FROM star), firsts AS (SELECT season, sum(votes) AS total FROM votes GROUP BY 1), pool AS (SELECT f.season, f.snapshot_date, pl.position, "
    + ", ".join(f"CASE WHEN count(f.{c}) >= 5 THEN avg(f.{c}) END AS m_{c}, CASE WHEN count(f.{c}) >= 5 THEN nullif(stddev_pop(f.{c}), 0) END AS d_{c}" for c in _POSITIONAL)
    + """ FROM form f JOIN player pl USING (player_id) GROUP BY 1, 2, 3),
  rel AS (SELECT *, """
    + ", ".join(f"{_relative_sql(c)} AS {c}_rel" for c in relative_columns())
    + """, week_index / nullif(max(week_index) OVER (PARTITION BY season), 0)::DOUBLE AS progress FROM deltas WINDOW g AS (PARTITION BY season, snapshot_date)),
  design AS (SELECT r.*, CASE WHEN fi.total > 0 THEN coalesce(v.votes, 0) / fi.total END AS first_place_share, """
    + ", ".join(f"(r.{c} - po.m_{c}) / po.d_{c} AS {c}_pos" for c in _POSITIONAL)
    + """, CAST(r.position = 'ASIA' AS INT) AS is_asia, CAST(r.position = 'EUROPE' AS INT) AS is_europe, r.season || '|' || r.snapshot_date AS group_key
    FROM rel r LEFT JOIN firsts fi ON fi.season = r.season LEFT JOIN votes v ON v.season = r.season AND v.player_id = r.player_id
    LEFT JOIN pool po ON po.season = r.season AND po.snapshot_date = r.snapshot_date AND po.position = r.position) """
)


def design_columns() -> list[str]:
    return [*[f"{c}_d1" for c in delta_columns()], *[f"{c}_rel" for c in relative_columns()], *[f"{c}_pos" for c in _POSITIONAL], "progress", "first_place_share"]


def design(spark, sf):
    """The feature table with deltas, one relative encoding a column, progress, positional z and the first-place label."""
    rows = star(spark, sf).withColumns({f"{c}_d1": F.col(c) - F.col(f"prior_{c}") for c in delta_columns()})
    encode = {"z": relative.zscore, "pct": relative.member_rank}
    rows = rows.withColumns({f"{c}_rel": encode[relative_kind(c)](c, SNAP) for c in relative_columns()})
    most = F.max("week_index").over(Window.partitionBy("season"))
    rows = rows.withColumn("progress", F.col("week_index") / F.nullif(most, F.lit(0)))
    votes = roles.award_voting(roles.game_log(spark, sf)).filter(F.col("award") == AWARD)
    firsts = F.broadcast(votes.groupBy("season").agg(F.sum("votes").alias("total")))  # a row a season
    rows = rows.join(firsts, "season", "left").join(votes.select("player_id", "season", "votes"), ["player_id", "season"], "left")
    rows = rows.withColumn("first_place_share", F.when(F.col("total") > 0, F.coalesce("votes", F.lit(0)) / F.nullif(F.col("total"), F.lit(0))))
    pool = _form(spark, sf)[2].join(roles.player(spark, sf).select("player_id", "position"), "player_id").groupBy(*SNAP, "position")
    enough = {c: F.count(c) >= 5 for c in _POSITIONAL}
    pool = pool.agg(*[x for c in _POSITIONAL for x in (F.when(enough[c], F.avg(c)).alias(f"m_{c}"), F.when(enough[c], F.nullif(F.stddev_pop(c), F.lit(0.0))).alias(f"d_{c}"))])
    rows = rows.join(F.broadcast(pool), [*SNAP, "position"], "left")  # a row a snapshot and position
    rows = rows.withColumns({f"{c}_pos": (F.col(c) - F.col(f"m_{c}")) / F.col(f"d_{c}") for c in _POSITIONAL})
    flags = {f"is_{p}": (F.col("position") == p.upper()).cast("int") for p in ("asia", "europe")}
    return rows.withColumns({**flags, "group_key": F.concat_ws("|", F.col("season").cast("string"), F.col("snapshot_date").cast("string"))})


@query("design_matrix", _DESIGN + f"SELECT player_id, group_key, is_asia, is_europe, {', '.join(f'round({c}, 6) AS {c}' for c in design_columns())} FROM design WHERE first_place_share IS NOT NULL")
def design_matrix(spark, sf):
    """Rows without a first-place label go; a wanted column that is missing stops the job."""
    rows = design(spark, sf).filter("first_place_share is not null")
    kept = tables.keep_columns(rows, ["player_id", "group_key", *design_columns()], always=["is_asia", "is_europe", "is_moon"])
    return kept.select("player_id", "group_key", "is_asia", "is_europe", *[_r(F.col(c).cast("double")).alias(c) for c in design_columns()])


@query(
    "defensive_pool",
    with_roles("box", more=availability._QUAL + ", adv AS (SELECT player_id, season, snapshot_date, n_full FROM q WHERE n_full > 2)")
    + """SELECT player_id, season, snapshot_date, gp, n_full AS stops, CASE WHEN gp > 0 THEN round(n_full / gp, 6) END AS stops_pg,
  round(percent_rank() OVER (PARTITION BY season, snapshot_date ORDER BY CASE WHEN gp > 0 THEN n_full / gp END NULLS FIRST), 6) AS pct
FROM box b JOIN grid USING (season, snapshot_date) LEFT JOIN adv USING (player_id, season, snapshot_date)""",
    dates=("snapshot_date",),
)
def defensive_pool(spark, sf):
    """Box rows on the grid with a second feed where it has them; a null rate stays in the pool at rank 0."""
    log = roles.game_log(spark, sf)
    feed = availability._qualifying(spark, sf).filter("n_full > 2").select(*KEY, F.col("n_full").alias("stops"))
    rows = roles.box_asof(log).join(F.broadcast(roles.grid(log).select(*SNAP)), SNAP).join(feed, KEY, "left")
    rows = rows.withColumn("rate", F.try_divide("stops", "gp"))
    return rows.select(*KEY, "gp", "stops", _r("rate").alias("stops_pg"), _r(relative.pool_rank("rate", SNAP)).alias("pct"))


@query(
    "entropy_merge",
    with_roles("box", "voting", more="""h AS (SELECT season, award, CASE WHEN count(*) > 1 THEN -sum(vote_share * ln(vote_share)) / ln(count(*)) END AS entropy FROM voting WHERE vote_share > 0 AND season % 2 = 0 GROUP BY 1, 2),
  f AS (SELECT season, snapshot_date, week_index / nullif(max(week_index) OVER (PARTITION BY season), 0)::DOUBLE AS frac FROM grid)""")
    + "SELECT v.player_id, v.season, v.award, f.snapshot_date, round(h.entropy, 6) AS entropy, round(h.entropy * f.frac, 6) AS entropy_frac FROM voting v JOIN f ON f.season = v.season LEFT JOIN h ON h.season = v.season AND h.award = v.award WHERE v.rank <= 10",
    dates=("snapshot_date",),
)
def entropy_merge(spark, sf):
    """The closeness of each race, and that times progress, merged on four columns; null where a season has none."""
    log = roles.game_log(spark, sf)
    votes = roles.award_voting(log)
    p = F.col("vote_share")
    n = F.count(F.lit(1))
    closeness = votes.filter("vote_share > 0 and season % 2 = 0").groupBy("season", "award").agg(F.when(n > 1, -F.sum(p * F.ln(p)) / F.nullif(F.ln(n), F.lit(0.0))).alias("entropy"))
    most = F.max("week_index").over(Window.partitionBy("season"))
    frac = roles.grid(log).select(*SNAP, (F.col("week_index") / F.nullif(most, F.lit(0))).alias("frac"))
    rows = votes.filter("rank <= 10").join(F.broadcast(frac), "season").join(closeness, ["season", "award"], "left")
    return rows.select("player_id", "season", "award", "snapshot_date", _r("entropy").alias("entropy"), _r(F.col("entropy") * F.col("frac")).alias("entropy_frac"))


@query(
    "first_place_points",
    with_roles("scores", more="""keyed AS (SELECT candidate, 'book|' || (grp % 5) || '|2000-01-0' || (1 + grp % 3) AS group_key, list_avg(raw) AS mu FROM scores),
  p AS (SELECT *, exp(mu - max(mu) OVER w) / sum(exp(mu)) OVER w * exp(max(mu) OVER w) AS fp FROM keyed WINDOW w AS (PARTITION BY group_key)),
  hop AS (SELECT s_suppkey AS nba_id, s_suppkey * 3 AS candidate FROM supplier)""")
    + "SELECT h.nba_id, split_part(group_key, '|', 3) AS snapshot, round(fp, 6) AS first_place FROM hop h LEFT JOIN p ON p.candidate = h.candidate",
)
def first_place_points(spark, sf):
    """Scores to points by group key, whose third field is the snapshot; ids reach them by a hop, null if unscored."""
    mean = F.aggregate("raw", F.lit(0.0), lambda a, x: a + x) / F.size("raw")
    key = F.concat(F.lit("book|"), (F.col("grp") % 5).cast("string"), F.lit("|2000-01-0"), (1 + F.col("grp") % 3).cast("string"))
    rows = roles.scores(spark, sf).select("candidate", key.alias("group_key"), mean.alias("mu"))
    points = rows.select("candidate", F.split_part("group_key", F.lit("|"), F.lit(3)).alias("snapshot"), relative.softmax(F.col("mu"), ["group_key"]).alias("fp"))
    hop = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("nba_id"), (F.col("s_suppkey") * 3).alias("candidate"))
    return hop.join(points, "candidate", "left").select("nba_id", "snapshot", _r("fp").alias("first_place"))


@query(
    "top_finisher_trace",
    with_roles("box", "voting", more="""ranked AS (SELECT *, percent_rank() OVER (PARTITION BY season, snapshot_date ORDER BY pts) AS pct FROM box),
  firsts AS (SELECT player_id, season, min(snapshot_date) FILTER (WHERE pct >= 0.9) AS first_clear, max(pct) AS best FROM ranked GROUP BY 1, 2)""")
    + "SELECT v.season, v.award, v.rank, v.player_id, f.first_clear, round(f.best, 6) AS best_pct, CAST(f.first_clear IS NULL AS INT) AS missed FROM voting v LEFT JOIN firsts f ON f.player_id = v.player_id AND f.season = v.season WHERE v.rank <= 3",
    dates=("first_clear",),
)
def top_finisher_trace(spark, sf):
    """Where each race's first three first cleared the gate, and how near those came that never did."""
    log = roles.game_log(spark, sf)
    box = roles.box_asof(log).withColumn("pct", relative.pool_rank("pts", SNAP))
    firsts = box.groupBy("player_id", "season").agg(F.min(F.when(F.col("pct") >= features.GATE, F.col("snapshot_date"))).alias("first_clear"), F.max("pct").alias("best"))
    tops = roles.award_voting(log).filter("rank <= 3").select("season", "award", F.col("rank").cast("long").alias("rank"), "player_id")
    rows = tops.join(firsts, ["player_id", "season"], "left")
    return rows.select("season", "award", "rank", "player_id", "first_clear", _r("best").alias("best_pct"), F.col("first_clear").isNull().cast("int").alias("missed"))
