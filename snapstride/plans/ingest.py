"""Queries that build the fact and dimension rows from landed feeds.

orders stand for the game feed, customer for the player list, supplier for the draft list,
nation for teams and their conferences, events for price histories and injury reports.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import classify, parse
from ..session import shared_dir, table
from ..sources import backfill, tables
from . import roles
from .availability import _INJ, injuries
from .parsing import _case, _list
from .registry import query
from .roles import with_roles


def _r(c, n=6):
    return F.round(c, n)


def _abbr(key):
    return F.concat(F.lit("N"), F.lpad(key.cast("string"), 2, "0"))


# The feed as it lands: every 97th game has no player, opponents beyond the last team are unknown.
_FEED = """feed AS (SELECT o_orderkey AS game_id, CASE WHEN o_orderkey % 97 <> 0 THEN o_custkey END AS player_id, CAST(o_orderdate AS DATE) AS game_date, CAST(year(o_orderdate) AS INT) AS season,
    c_nationkey AS team_id, o_totalprice AS points, CASE WHEN (o_orderkey // 7) % 27 < 25 THEN (o_orderkey // 7) % 27 END AS opp FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _feed(spark, sf):
    """game_id, player_id, game_date, season, team_id, matchup, points; the opponent is only in the text."""
    team = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("team_id"))
    sign = F.when(F.col("o_orderkey") % 2 == 0, " vs. ").otherwise(" @ ")
    other = F.floor(F.col("o_orderkey") / 7) % 27
    rows = table(spark, sf, "orders").join(team, "o_custkey")
    day = F.to_date("o_orderdate")
    return rows.select(
        F.col("o_orderkey").alias("game_id"),
        F.when(F.col("o_orderkey") % 97 != 0, F.col("o_custkey")).alias("player_id"),
        day.alias("game_date"),
        F.year(day).alias("season"),
        "team_id",
        F.concat(_abbr(F.col("team_id")), sign, _abbr(other)).alias("matchup"),
        F.col("o_totalprice").alias("points"),
    )


def _game_log(spark, sf):
    """The feed with the opponent looked up; rows without their natural key are marked, not yet dropped."""
    teams = table(spark, sf, "nation").select(_abbr(F.col("n_nationkey")).alias("abbr"), F.col("n_nationkey").alias("opp_team_id"))
    rows = _feed(spark, sf).withColumn("abbr", parse.opponent(F.col("matchup"))).join(F.broadcast(teams), "abbr", "left")  # one row a team
    return rows.withColumn("whole", F.col("player_id").isNotNull() & F.col("game_id").isNotNull())


@query(
    "game_log_build",
    f"WITH {_FEED} SELECT game_id, player_id, game_date, season, team_id, opp AS opp_team_id, points FROM feed WHERE player_id IS NOT NULL",
    dates=("game_date",),
)
def game_log_build(spark, sf):
    return _game_log(spark, sf).filter("whole").select("game_id", "player_id", "game_date", "season", "team_id", "opp_team_id", "points")


@query(
    "game_log_tally",
    f"WITH {_FEED} SELECT season, count(*) FILTER (WHERE player_id IS NOT NULL) AS built, count(*) FILTER (WHERE player_id IS NULL) AS dropped, count(*) FILTER (WHERE opp IS NULL) AS unresolved FROM feed GROUP BY 1",
)
def game_log_tally(spark, sf):
    return _game_log(spark, sf).groupBy("season").agg(F.count_if("whole").alias("built"), F.count_if(~F.col("whole")).alias("dropped"), F.count_if(F.col("opp_team_id").isNull()).alias("unresolved"))


@query(
    "player_build",
    """SELECT c_custkey AS player_id, c_name AS name, CASE WHEN s_suppkey IS NOT NULL THEN CAST(s_suppkey % 60 + 1 AS INT) END AS draft_pick,
  CASE WHEN s_suppkey IS NOT NULL THEN CAST(s_suppkey % 60 + 1 <= 14 AS INT) END AS lottery, n_name AS country
FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""",
)
def player_build(spark, sf):
    draft = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), (F.col("s_suppkey") % 60 + 1).cast("int").alias("draft_pick"))
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country"))
    rows = table(spark, sf, "customer").join(draft, "c_custkey", "left").join(nation, "c_nationkey", "left")
    lottery = F.when(F.col("draft_pick").isNotNull(), (F.col("draft_pick") <= 14).cast("int"))
    return rows.select(F.col("c_custkey").alias("player_id"), F.col("c_name").alias("name"), "draft_pick", lottery.alias("lottery"), "country")


@query(
    "team_build",
    "SELECT n_nationkey AS team_id, n_name AS name, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS abbr, r_name AS conference FROM nation JOIN region ON n_regionkey = r_regionkey",
)
def team_build(spark, sf):
    region = table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("conference"))
    return table(spark, sf, "nation").join(region, "n_regionkey").select(F.col("n_nationkey").alias("team_id"), F.col("n_name").alias("name"), _abbr(F.col("n_nationkey")).alias("abbr"), "conference")


@query(
    "advanced_build",
    with_roles("game_log", more="a AS (SELECT player_id, season, count(*) AS gp, sum(points) AS points, sum(minutes) AS minutes, count(*) FILTER (WHERE award = 'R') AS fouls FROM game_log GROUP BY 1, 2)")
    + """SELECT player_id, season, gp, round(points / minutes, 9) AS off_rating, CASE WHEN fouls > 0 THEN round(minutes / fouls, 9) END AS minutes_per_foul,
  CASE WHEN 2 * (minutes + 0.44 * fouls) > 0 THEN round(points / (2 * (minutes + 0.44 * fouls)), 9) END AS ts_pct FROM a""",
)
def advanced_build(spark, sf):
    sums = roles.game_log(spark, sf).groupBy("player_id", "season").agg(F.count(F.lit(1)).alias("gp"), F.sum("points").alias("points"), F.sum("minutes").alias("minutes"), F.count_if(F.col("award") == "R").alias("fouls"))
    per_foul = F.when(F.col("fouls") > 0, _r(F.col("minutes") / F.nullif(F.col("fouls"), F.lit(0)), 9))
    return sums.select("player_id", "season", "gp", _r(F.col("points") / F.col("minutes"), 9).alias("off_rating"), per_foul.alias("minutes_per_foul"), _r(parse.true_shooting(F.col("points"), F.col("minutes"), F.col("fouls")), 9).alias("ts_pct"))


@query(
    "team_record_build",
    """WITH g AS (SELECT c_nationkey AS team_id, CAST(year(o_orderdate) AS INT) AS season, o_orderstatus AS st, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey),
 s AS (SELECT team_id, season, count(*) FILTER (WHERE st = 'F') AS wins, count(*) FILTER (WHERE st <> 'F') AS losses FROM g GROUP BY 1, 2),
 c AS (SELECT s.*, n_regionkey AS conference, wins / (wins + losses) AS pct FROM s JOIN nation ON n_nationkey = team_id),
 a AS (SELECT team_id, season, round(avg(o_totalprice), 6) AS net_rating FROM g WHERE season % 2 = 1 GROUP BY 1, 2)
SELECT c.team_id, c.season, wins, losses, round(pct, 9) AS win_pct, rank() OVER (PARTITION BY c.season, conference ORDER BY pct DESC) AS conf_rank,
  rank() OVER (PARTITION BY c.season, conference ORDER BY pct DESC) AS projected_seed, net_rating, CAST(NULL AS DOUBLE) AS sos
FROM c LEFT JOIN a ON a.team_id = c.team_id AND a.season = c.season""",
)
def team_record_build(spark, sf):
    """Standings with the advanced feed where it has the season; strength of schedule is never known."""
    team = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("team_id"))
    games = table(spark, sf, "orders").join(team, "o_custkey").select("team_id", F.year("o_orderdate").alias("season"), (F.col("o_orderstatus") == "F").alias("won"), "o_totalprice")
    key = ["team_id", "season"]
    standings = games.groupBy(*key).agg(F.count_if("won").alias("wins"), F.count_if(~F.col("won")).alias("losses"))
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("team_id"), F.col("n_regionkey").alias("conference"))
    advanced = games.filter("season % 2 = 1").groupBy(*key).agg(_r(F.avg("o_totalprice")).alias("net_rating"))
    rows = standings.join(F.broadcast(nation), "team_id").withColumn("pct", F.col("wins") / (F.col("wins") + F.col("losses"))).join(advanced, key, "left")
    rank = F.rank().over(Window.partitionBy("season", "conference").orderBy(F.col("pct").desc())).cast("long")
    return rows.select(*key, "wins", "losses", _r("pct", 9).alias("win_pct"), rank.alias("conf_rank"), rank.alias("projected_seed"), "net_rating", F.lit(None).cast("double").alias("sos"))


@query(
    "history_rows",
    """SELECT user_id AS candidate, date_trunc('second', ts) AS seen_at, round(value / (value + 50e0), 9) AS price, CAST(NULL AS DOUBLE) AS best_bid, CAST(NULL AS DOUBLE) AS best_ask
FROM events WHERE event_id % 13 <> 0 AND event_id % 17 <> 0""",
    dates=("seen_at",),
)
def history_rows(spark, sf):
    """Histories landed as {t, p} points, t in epoch seconds; points without t or p go, depth is unknown."""
    rows = table(spark, sf, "events")
    t = F.when(F.col("event_id") % 13 != 0, F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000))
    p = F.when(F.col("event_id") % 17 != 0, F.col("value") / (F.col("value") + roles.PRICE_HALF))
    landed = rows.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.to_json(F.struct(F.collect_list(F.struct(t.alias("t"), p.alias("p"))).alias("history"))).alias("raw"))
    return parse.history_points(landed.withColumnRenamed("user_id", "candidate"), "candidate", "raw").withColumn("price", _r("price", 9)).withColumnRenamed("at", "seen_at")


_CATEGORY = f"""plain AS (SELECT *, lower(trim(coalesce(description, ''))) AS d FROM inj),
  stripped AS (SELECT *, regexp_replace(d, '{classify.REPORT_PREFIX}', ' ', 'g') AS s FROM plain),
  reasons AS (SELECT *, CASE WHEN d = '' THEN 'unknown' WHEN regexp_matches(s, '{classify.SEASON_ENDING}') OR (regexp_matches(s, '{classify.SEVERE_PART}') AND (regexp_matches(s, '{classify.SEVERE_TOKEN}') OR NOT regexp_matches(s, '{classify.BENIGN_TOKEN}'))) THEN 'season_ending'
    ELSE {_case("s", classify.REASON_RULES, "'unknown'")} END AS category, regexp_matches(d, '{classify.NON_INJURY}') AS other FROM stripped)"""


def _reasons(spark, sf):
    text = F.col("description")
    return injuries(spark, sf).select("player_id", "day", "description", classify.reason(text).alias("category"), classify.non_injury(text).alias("other"))


@query(
    "reason_histogram",
    with_roles(more=f"{_INJ}, {_CATEGORY}, cats AS (SELECT unnest({_list(classify.CATEGORIES)}) AS category)")
    + "SELECT c.category, count(r.player_id) AS reports, count(r.player_id) FILTER (WHERE NOT r.other) AS injuries FROM cats c LEFT JOIN reasons r ON r.category = c.category GROUP BY 1",
)
def reason_histogram(spark, sf):
    """Reports by category, those that no report has among them, and without what is no injury."""
    every = spark.createDataFrame([(c,) for c in classify.CATEGORIES], "category string")
    counts = _reasons(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("other")).alias("own"))
    return every.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("reports"), F.coalesce("own", F.lit(0)).alias("injuries"))


@query("reason_audit", with_roles(more=f"{_INJ}, {_CATEGORY}") + "SELECT category, description, count(*) AS n, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, description) AS place FROM reasons GROUP BY 1, 2")
def reason_audit(spark, sf):
    """The distinct descriptions behind each category, the commonest first."""
    rows = _reasons(spark, sf).groupBy("category", "description").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy(F.col("n").desc(), "description")).cast("long"))


@query(
    "book_snapshot",
    """SELECT user_id AS candidate, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(round(value, 6), (ts, event_id)) AS mid,
  arg_max(struct_pack(x := TRY_CAST(json_extract_string(props, '$.k') AS INT)), (ts, event_id)).x AS depth, CAST(NULL AS DOUBLE) AS spread FROM events GROUP BY 1""",
)
def book_snapshot(spark, sf):
    """The latest book of each candidate, field by field: what cannot be read is null, the row stays."""
    last = F.struct("ts", "event_id")
    raw = table(spark, sf, "events").groupBy(F.col("user_id").alias("candidate")).agg(F.max_by(F.struct("event_id", "value", "props"), last).alias("b"))
    field = lambda name, kind: F.get_json_object("b.props", f"$.{name}").try_cast(kind)
    return raw.select("candidate", "b.event_id", _r("b.value").alias("mid"), field("k", "int").alias("depth"), field("spread", "double").alias("spread"))


@query(
    "targeted_backfill",
    """WITH wanted AS (SELECT DISTINCT user_id FROM events WHERE event_type IN ('purchase', 'error') ORDER BY user_id LIMIT 50),
 pts AS (SELECT e.user_id, event_type, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 WHEN 'view' THEN 3 ELSE 4 END AS rk FROM events e JOIN wanted w ON w.user_id = e.user_id),
 best AS (SELECT user_id, min(rk) AS rk FROM pts GROUP BY 1)
SELECT p.user_id, p.event_type, count(*) AS points FROM pts p JOIN best b ON b.user_id = p.user_id AND b.rk = p.rk GROUP BY 1, 2""",
)
def targeted_backfill(spark, sf):
    """The finest history of the first 50 candidates that a filter names; the limit is the command's."""
    from ..sources import landing

    rows = table(spark, sf, "events")
    wanted = rows.filter(F.col("event_type").isin("purchase", "error")).select("user_id").distinct().orderBy("user_id").limit(50)
    rank = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", 2).when(F.col("event_type") == "view", 3).otherwise(4)
    points = rows.join(F.broadcast(wanted), "user_id", "left_semi").select("user_id", "event_type", "ts", rank.alias("rk"))
    return landing.finest_history(points, "user_id", "rk").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("points"))


@query(
    "selection_registry",
    """WITH kept AS (SELECT p_brand AS award, p_partkey AS seq, p_name, p_type, p_size FROM part), last AS (SELECT award, max(seq) AS seq FROM kept GROUP BY 1)
SELECT k.award, k.seq AS selection_id, unnest([k.p_name, k.p_type, 'size_' || k.p_size]) AS column_name, unnest([0, 1, 2]) AS place FROM kept k JOIN last l ON l.award = k.award AND l.seq = k.seq""",
)
def selection_registry(spark, sf):
    """The columns of each award's latest selection, kept as JSON text in a registry table."""
    kept = F.to_json(F.array("p_name", "p_type", F.concat(F.lit("size_"), F.col("p_size").cast("string"))))
    registry = table(spark, sf, "part").select(F.col("p_brand").alias("award"), F.col("p_partkey").alias("selection_id"), kept.alias("kept"))
    return tables.latest_selection(registry, "award", "selection_id", "kept")


@query(
    "season_backfill",
    f"""WITH {_FEED} SELECT season, count(*) AS rows, count(*) FILTER (WHERE player_id IS NULL) AS failed, count(*) FILTER (WHERE player_id IS NULL AND game_id % 2 = 0) AS residual,
  count(*) FILTER (WHERE player_id IS NULL AND game_id % 2 = 0) = 0 AS complete FROM feed WHERE season >= 1994 AND season <> 1995 GROUP BY 1""",
)
def season_backfill(spark, sf):
    """Two passes over the open seasons, newest first: what fails is built again from the cache."""
    feed = _feed(spark, sf)
    landed = shared_dir(spark, "feed")
    feed.write.partitionBy("season").parquet(landed)
    cached = spark.read.parquet(landed)
    done = spark.createDataFrame([("games", 1995)], "pull_type string, season int")
    work = tables.work_list(spark, done, "games", 1994, 2001)

    def again(rows):  # the cache can restore the player of odd games
        return rows.withColumn("player_id", F.when(F.col("game_id") % 2 == 1, F.coalesce("player_id", "game_id")).otherwise(F.col("player_id")))

    return backfill.two_passes(cached.join(F.broadcast(work.select("season")), "season", "left_semi"), "season", F.col("player_id").isNotNull(), again)


_PAGE = """<h1><span>{name}</span></h1><p>Position: {position}</p><span id="necro-birth" data-birth="{born}"></span><table><tr><th data-stat="season">{first}</th></tr><tr><th data-stat="season">{last}</th></tr></table>"""
_SPOTS = ["Point Guard", "Shooting Guard and Point Guard", "Small Forward", "Power Forward and Center", "Center", "Coach"]


@query(
    "player_pages",
    f"""SELECT s_suppkey AS bref_id, s_name AS name, (['PG', 'SG', 'SF', 'PF', 'C', NULL])[s_suppkey % 6 + 1] AS position,
  CASE WHEN s_suppkey % 10 <> 0 THEN CAST(DATE '1980-01-01' + CAST(s_suppkey % 5000 AS INT) AS DATE) END AS born, CAST(2000 + s_suppkey % 10 AS INT) AS first_season, CAST(2000 + s_suppkey % 10 + 3 AS INT) AS last_season FROM supplier""",
    dates=("born",),
)
def player_pages(spark, sf):
    """Fields of player pages, which are made here from the supplier table's rows."""
    key = F.col("s_suppkey")
    born = F.when(key % 10 != 0, F.date_add(F.lit("1980-01-01").cast("date"), (key % 5000).cast("int")).cast("string")).otherwise("n/a")
    first = F.lit(2000) + key % 10

    def label(year):
        return F.concat(year.cast("string"), F.lit("-"), F.lpad(((year + 1) % 100).cast("string"), 2, "0"))

    values = {"name": F.col("s_name"), "position": F.element_at(F.array(*[F.lit(x) for x in _SPOTS]), (key % 6 + 1).cast("int")), "born": born, "first": label(first), "last": label(first + 3)}
    html = F.lit(_PAGE)
    for name, value in values.items():
        html = F.replace(html, F.lit("{" + name + "}"), value)
    return parse.player_page(table(spark, sf, "supplier").select(key.alias("bref_id"), html.alias("html")), "bref_id", "html")


@query(
    "award_pages",
    with_roles("voting") + "SELECT season, award, 'p' || player_id AS bref_id, CAST(votes AS INT) AS first_place_votes, CAST(revenue AS DOUBLE) AS total_points, round(vote_share, 6) AS vote_share, CAST(rank AS INT) AS rank, won AS won_flag FROM voting WHERE rank <= 10",
)
def award_pages(spark, sf):
    """Ten rows of each season's three award tables, written as a page with comments and parsed back."""
    votes = roles.award_voting(roles.game_log(spark, sf)).filter("rank <= 10")
    cells = {"rank": F.col("rank"), "player": F.concat(F.lit('<a href="/players/x/p'), F.col("player_id"), F.lit('.html">P</a>')), "votes_first": F.col("votes"), "points_won": F.format_number("revenue", 0), "award_share": F.format_number(_r("vote_share"), 6)}
    row = F.concat(F.lit("<tr>"), *[x for n, v in cells.items() for x in (F.lit(f'<td data-stat="{n}">'), v.cast("string"), F.lit("</td>"))], F.lit("</tr>"))
    made = votes.groupBy("season", "award").agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("rows"))
    head = F.lit('<tr><th data-stat="player">Player</th></tr>')
    one = F.concat(F.lit('<!--<table id="'), F.col("award"), F.lit('">'), head, F.col("rows"), F.lit("</table>-->"))
    pages = made.groupBy("season").agg(F.array_join(F.collect_list(one), "").alias("html"), F.collect_set("award").alias("awards"))
    tables_of = pages.select("season", F.explode("awards").alias("award"), "html")
    found = tables_of.lateralJoin(parse.vote_table()(F.col("html").outer(), F.col("award").outer()))
    return found.select("season", "award", "bref_id", "first_place_votes", "total_points", "vote_share", "rank", "won_flag")
