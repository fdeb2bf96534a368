"""Queries on availability, injuries and the reweights they feed."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import classify, pricing
from ..operators import asof, relative
from ..session import table
from . import roles
from .parsing import REPORTS, _case, _list
from .registry import query
from .roles import with_roles


def _r(c, n=6):
    return F.round(c, n)


_STATUS = ["out", "doubtful", "questionable", "probable"]
_INJ = f"""injuries AS (SELECT user_id AS player_id, CAST(ts AS DATE) AS day, arg_max(CAST(json_extract_string(props, '$.k') AS INT), (ts, event_id)) AS k FROM events WHERE event_type = 'error' GROUP BY 1, 2),
  inj AS (SELECT player_id, day, ({_list(_STATUS)})[k % 4 + 1] AS status, ({_list(REPORTS)})[k % 12 + 1] AS description FROM injuries)"""


def injuries(spark, sf):
    """player_id, day, status, description; the last report of a day counts."""
    rows = table(spark, sf, "events").filter("event_type = 'error'").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    days = rows.groupBy(F.col("user_id").alias("player_id"), F.to_date("ts").alias("day")).agg(F.max_by("k", F.struct("ts", "event_id")).alias("k"))

    def pick(values, n):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("k") % n + 1).cast("int"))

    return days.select("player_id", "day", pick(_STATUS, 4).alias("status"), pick(REPORTS, 12).alias("description"))


_QUAL = """q AS (SELECT g.player_id, s.season, s.snapshot_date, count(DISTINCT l_orderkey) AS appeared, count(DISTINCT CASE WHEN minutes >= 20 THEN l_orderkey END) AS n_full,
   count(DISTINCT CASE WHEN minutes >= 15 AND minutes < 20 THEN l_orderkey END) AS n_near FROM game_log g JOIN grid s ON g.season = s.season AND g.game_date <= s.snapshot_date GROUP BY 1, 2, 3)"""


def _qualifying(spark, sf):
    """Distinct games so far by minutes played, in one pass.

    A game's first month in each band is found first, so the distinct counts become running
    sums over at most twelve rows.
    """
    log = roles.game_log(spark, sf).withColumn("snapshot_date", F.last_day("game_date"))
    full, near = F.col("minutes") >= 20, (F.col("minutes") >= 15) & (F.col("minutes") < 20)
    firsts = log.groupBy("player_id", "season", "l_orderkey").agg(F.min("snapshot_date").alias("a"), F.min(F.when(full, F.col("snapshot_date"))).alias("f"), F.min(F.when(near, F.col("snapshot_date"))).alias("n"))
    marks = firsts.select("player_id", "season", F.explode(F.array(*[F.struct(F.col(c).alias("snapshot_date"), F.lit(c).alias("kind")) for c in "afn"])).alias("m"))
    months = marks.select("player_id", "season", "m.*").filter("snapshot_date is not null").groupBy("player_id", "season", "snapshot_date").agg(*[F.count_if(F.col("kind") == c).alias(c) for c in "afn"])
    spots = log.select("player_id", "season").distinct().join(F.broadcast(roles.grid(log).select("season", "snapshot_date")), "season")
    so_far = Window.partitionBy("player_id", "season").orderBy("snapshot_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = {"a": "appeared", "f": "n_full", "n": "n_near"}
    rows = spots.join(months, ["player_id", "season", "snapshot_date"], "left").select("player_id", "season", "snapshot_date", *[F.sum(c).over(so_far).alias(n) for c, n in names.items()])
    return rows.filter("appeared > 0")


@query(
    "qualifying_games",
    with_roles("grid", more=_QUAL)
    + "SELECT player_id, season, snapshot_date, appeared, n_full + least(2, n_near) AS qualifying, round(least(0.995, greatest(0.02, n_full / appeared)), 6) AS p FROM q",
    dates=("snapshot_date",),
)
def qualifying_games(spark, sf):
    p = pricing.clip(F.col("n_full") / F.col("appeared"), 0.02, 0.995)
    return _qualifying(spark, sf).select("player_id", "season", "snapshot_date", "appeared", (F.col("n_full") + F.least(F.lit(2).cast("long"), F.col("n_near"))).alias("qualifying"), _r(p).alias("p"))


_CAL = "cal AS (SELECT player_id, d.day FROM (SELECT DISTINCT player_id FROM inj) JOIN (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) d ON true)"


@query(
    "injury_asof",
    with_roles(more=f"{_INJ}, {_CAL}".lstrip(", "))
    + """SELECT c.player_id, c.day, CASE WHEN date_diff('day', max(i.day), c.day) <= 10 THEN arg_max(i.status, i.day) END AS status, CAST(date_diff('day', max(i.day), c.day) AS BIGINT) AS age
FROM cal c LEFT JOIN inj i ON i.player_id = c.player_id AND i.day <= c.day GROUP BY 1, 2""",
    dates=("day",),
)
def injury_asof(spark, sf):
    reports = injuries(spark, sf)
    days = table(spark, sf, "events").select(F.to_date("ts").alias("day")).distinct()
    calendar = reports.select("player_id").distinct().crossJoin(F.broadcast(days))
    found = asof.latest(calendar, reports.withColumn("since", F.col("day")), ["player_id"], "day", "since", ["description"], ["status", "since"])
    age = F.date_diff("day", "since")
    return found.select("player_id", "day", F.when(age <= 10, F.col("status")).alias("status"), age.cast("long").alias("age"))


_MISS = """sched AS (SELECT season, day, row_number() OVER (PARTITION BY season ORDER BY day) AS seq FROM (SELECT DISTINCT season, date_trunc('week', game_date)::DATE AS day FROM game_log)),
  apps AS (SELECT DISTINCT player_id, season, date_trunc('week', game_date)::DATE AS day FROM game_log),
  grd AS (SELECT p.player_id, s.season, s.day, s.seq, (a.player_id IS NOT NULL) AS played FROM (SELECT DISTINCT player_id, season FROM game_log) p JOIN sched s USING (season) LEFT JOIN apps a ON a.player_id = p.player_id AND a.season = s.season AND a.day = s.day),
  miss AS (SELECT *, min(CASE WHEN played THEN seq END) OVER (PARTITION BY player_id, season ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt,
                    max(CASE WHEN played THEN seq END) OVER (PARTITION BY player_id, season ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prv,
                    max(seq) OVER (PARTITION BY season) AS last FROM grd)"""


def _missed(spark, sf):
    """Weeks without a game: how many more follow (censored at the season's end), how many came before."""
    log = roles.game_log(spark, sf).withColumn("day", F.to_date(F.date_trunc("week", "game_date")))
    weeks = log.select("season", "day").distinct().withColumn("seq", F.row_number().over(Window.partitionBy("season").orderBy("day")).cast("long"))
    weeks = weeks.withColumn("last", F.max("seq").over(Window.partitionBy("season")))
    played = log.select("player_id", "season", "day").distinct().withColumn("played", F.lit(True))
    rows = log.select("player_id", "season").distinct().join(F.broadcast(weeks), "season").join(played, ["player_id", "season", "day"], "left")
    run = Window.partitionBy("player_id", "season").orderBy("seq")
    at = F.when(F.col("played"), F.col("seq"))
    rows = rows.withColumn("nxt", F.min(at).over(run.rowsBetween(1, Window.unboundedFollowing))).withColumn("prv", F.max(at).over(run.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.filter("played is null")
    return rows.withColumn("missed", F.coalesce("nxt", F.col("last") + 1) - F.col("seq")).withColumn("elapsed", F.col("seq") - F.coalesce("prv", F.lit(0))).withColumn("censored", F.col("nxt").isNull().cast("int"))


@query(
    "missed_streaks",
    with_roles("game_log", more=_MISS)
    + "SELECT player_id, season, day, coalesce(nxt, last + 1) - seq AS missed, seq - coalesce(prv, 0) AS elapsed, CAST(nxt IS NULL AS INT) AS censored FROM miss WHERE NOT played",
    dates=("day",),
)
def missed_streaks(spark, sf):
    return _missed(spark, sf).select("player_id", "season", "day", "missed", "elapsed", "censored")


_CELLS = _MISS + f""", obs AS (SELECT ({_list(_STATUS)})[(player_id + seq) % 4 + 1] AS status, ({_list(REPORTS)})[(player_id * 7 + seq) % 12 + 1] AS description,
   coalesce(nxt, last + 1) - seq AS missed, CAST(nxt IS NULL AS INT) AS censored FROM miss WHERE NOT played),
  cat AS (SELECT *, {_case("regexp_replace(lower(trim(description)), '" + classify.REPORT_PREFIX + "', ' ', 'g')", classify.REASON_RULES, "'unknown'")} AS plain FROM obs),
  c2 AS (SELECT status, CASE WHEN regexp_matches(lower(description), 'acl; torn|achilles; n/a|femur') THEN 'season_ending' ELSE plain END AS category, missed, censored FROM cat),
  gs AS (SELECT status, category, count(*) AS n, avg(censored) AS censor_rate, avg(missed) AS mean, CAST(floor(median(missed)) AS BIGINT) AS med,
           list_sort(list(missed))[CAST(greatest(1, floor(0.9 * count(*))) AS INT)] AS p90 FROM c2 GROUP BY GROUPING SETS ((status, category), (category), ()))"""


def _observed(spark, sf):
    """status, category, missed, censored, n: how often each number of missed weeks was seen in each cell."""
    rows = _missed(spark, sf)

    def pick(values, of):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (of % len(values) + 1).cast("int"))

    seen = rows.select(pick(_STATUS, F.col("player_id") + F.col("seq")).alias("status"), classify.reason(pick(REPORTS, F.col("player_id") * 7 + F.col("seq"))).alias("category"), "missed", "censored")
    return seen.groupBy("status", "category", "missed", "censored").agg(F.count(F.lit(1)).alias("n"))


def _cells(spark, sf):
    """Statistics of missed weeks by cell, by category and of all.

    Rows are counted by value first, so that what a total is made of is a histogram of at most
    a season's weeks, not the rows.
    """
    seen = _observed(spark, sf)
    sets = seen.groupingSets([["status", "category", "missed"], ["category", "missed"], ["missed"]], "status", "category", "missed")
    counts = sets.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("censored")).alias("cut"), F.grouping_id().alias("level"))
    run = Window.partitionBy("level", "status", "category").orderBy("missed").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("level", "status", "category")
    counts = counts.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(whole))

    def nth(k):  # the k-th smallest, from 1
        return F.min(F.when(F.col("upto") >= k, F.col("missed")))

    total = F.col("all")
    middle = F.floor((nth(F.floor((total + 1) / 2)) + nth(F.ceil((total + 1) / 2))) / 2).cast("long")
    found = counts.groupBy("level", "status", "category").agg(
        F.sum("n").alias("n"), (F.sum("cut") / F.sum("n")).alias("censor_rate"), (F.sum(F.col("missed") * F.col("n")) / F.sum("n")).alias("mean"), middle.alias("med"), nth(F.greatest(F.lit(1), F.floor(total * 0.9))).alias("p90")
    )
    return found.drop("level")


@query("miss_cells", with_roles("game_log", more=_CELLS) + "SELECT status, category, n, round(censor_rate, 4) AS censor_rate, round(mean, 6) AS mean, med, p90 FROM gs")
def miss_cells(spark, sf):
    return _cells(spark, sf).select("status", "category", "n", _r("censor_rate", 4).alias("censor_rate"), _r("mean").alias("mean"), "med", "p90")


@query(
    "miss_cells_fallback",
    with_roles("game_log", more=_CELLS + f""", keys AS (SELECT s.status, c.category FROM (SELECT unnest({_list(_STATUS)}) AS status) s, (SELECT DISTINCT category FROM c2) c)""")
    + """SELECT k.status, k.category, CASE WHEN a.n >= 30 THEN 'cell' WHEN b.n >= 30 THEN 'category' ELSE 'all' END AS level,
  round(CASE WHEN a.n >= 30 THEN a.mean WHEN b.n >= 30 THEN b.mean ELSE t.mean END, 6) AS mean
FROM keys k LEFT JOIN gs a ON a.status = k.status AND a.category = k.category LEFT JOIN gs b ON b.status IS NULL AND b.category = k.category, (SELECT mean FROM gs WHERE status IS NULL AND category IS NULL) t""",
)
def miss_cells_fallback(spark, sf):
    cells = _cells(spark, sf)
    own = cells.filter("status is not null").select("status", "category", F.col("n").alias("n1"), F.col("mean").alias("m1"))
    margin = cells.filter("status is null and category is not null").select("category", F.col("n").alias("n2"), F.col("mean").alias("m2"))
    every = cells.filter("status is null and category is null").select(F.col("mean").alias("m3"))
    keys = margin.crossJoin(spark.createDataFrame([(s,) for s in _STATUS], "status string")).crossJoin(every)
    rows = keys.join(own, ["status", "category"], "left")
    level = F.when(F.col("n1") >= LEAST_CELL, "cell").when(F.col("n2") >= LEAST_CELL, "category").otherwise("all")
    mean = F.when(F.col("n1") >= LEAST_CELL, F.col("m1")).when(F.col("n2") >= LEAST_CELL, F.col("m2")).otherwise(F.col("m3"))
    return rows.select("status", "category", level.alias("level"), _r(mean).alias("mean"))


#: Observations from which a cell, or its category, speaks for itself.
LEAST_CELL = 30


def _samples(spark, sf):
    """status, category, misses, total: the sample of missed weeks that stands for each cell.

    The cell's own if it has enough, else its category's, else all. ``misses`` counts each
    number of weeks from 0 on; observations that the season's end cut off are in the total only.
    """
    seen = _observed(spark, sf)
    sets = seen.groupingSets([["status", "category", "missed", "censored"], ["category", "missed", "censored"], ["missed", "censored"]], "status", "category", "missed", "censored")
    counts = sets.agg(F.sum("n").alias("n")).groupBy("status", "category")
    ended = F.col("censored") == 0
    counts = counts.agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.when(ended, F.struct("missed", "n")))).alias("by"), F.max(F.when(ended, F.col("missed"))).alias("most"))
    misses = F.transform(F.sequence(F.lit(0).cast("long"), F.coalesce("most", F.lit(0))), lambda k: F.coalesce(F.try_element_at("by", k), F.lit(0)))
    cells = counts.select("status", "category", "total", misses.alias("misses"))
    parts = {k: cells.filter(c).drop(*d) for k, c, d in (("own", "status is not null", []), ("margin", "status is null and category is not null", ["status"]), ("every", "category is null", ["status", "category"]))}
    named = {k: df.withColumnsRenamed({"total": f"{k}_n", "misses": f"{k}_m"}) for k, df in parts.items()}
    keys = parts["margin"].select("category").crossJoin(spark.createDataFrame([(s,) for s in _STATUS], "status string"))
    rows = keys.join(named["own"], ["status", "category"], "left").join(named["margin"], "category").crossJoin(named["every"])  # a row a cell

    def chosen(c: str):
        return F.when(F.col("own_n") >= LEAST_CELL, F.col(f"own_{c}")).when(F.col("margin_n") >= LEAST_CELL, F.col(f"margin_{c}")).otherwise(F.col(f"every_{c}"))

    return rows.select("status", "category", chosen("m").alias("misses"), chosen("n").alias("total"))


def _sf_sql(needed: str, n: str, p: str) -> str:
    """Binomial survival by a list of terms, for integers needed and n."""
    term = f"exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p}))"
    return f"CASE WHEN {needed} <= 0 THEN 1e0 WHEN {n} < {needed} THEN 0e0 ELSE list_sum([{term} for i in range({needed}, {n} + 1)]) END"


#: Games that a player has to play, of a schedule that no player here exceeds.
NEEDED, GAMES = 65, 150

_SAMPLE = _CELLS + f""", obs_n AS (SELECT status, category, missed, censored, count(*) AS n FROM c2 GROUP BY 1, 2, 3, 4),
  lv AS (SELECT s.status, c.category, CASE WHEN a.n >= {LEAST_CELL} THEN 2 WHEN b.n >= {LEAST_CELL} THEN 1 ELSE 0 END AS lev FROM (SELECT unnest({_list(_STATUS)}) AS status) s JOIN (SELECT DISTINCT category FROM c2) c ON true
     LEFT JOIN gs a ON a.status = s.status AND a.category = c.category LEFT JOIN gs b ON b.status IS NULL AND b.category = c.category),
  sample AS (SELECT l.status, l.category, o.missed, o.censored, sum(o.n) AS n FROM lv l JOIN obs_n o ON (l.lev = 0 OR o.category = l.category) AND (l.lev < 2 OR o.status = l.status) GROUP BY 1, 2, 3, 4)"""

_ELIG = _QUAL + ", " + _SAMPLE + f""", e AS (SELECT player_id, season, snapshot_date, CAST(greatest(0, {NEEDED} - (n_full + least(2, n_near))) AS BIGINT) AS needed,
   CAST(greatest(0, {GAMES} - appeared) AS BIGINT) AS avail, least(0.995, greatest(0.02, n_full / appeared)) AS p, ({_list(_STATUS)})[player_id % 4 + 1] AS status FROM q WHERE appeared > 0),
  cats AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT category FROM c2)),
  hurt AS (SELECT e.player_id, e.season, e.snapshot_date, sum(s.n * CASE WHEN s.censored = 1 THEN 0 ELSE {_sf_sql("needed", "greatest(0, avail - s.missed)", "p")} END) / sum(s.n) AS mix
     FROM e JOIN cats ON cats.i = e.player_id % cats.k JOIN sample s ON s.status = e.status AND s.category = cats.category WHERE e.player_id % 5 = 0 AND needed > 0 AND avail > 0 GROUP BY 1, 2, 3),
  f AS (SELECT e.*, CASE WHEN e.season < 1993 OR needed = 0 THEN 1e0 WHEN avail <= 0 THEN 0e0 WHEN e.player_id % 5 = 0 AND e.status <> 'probable' THEN mix ELSE {_sf_sql("needed", "avail", "p")} END AS factor FROM e LEFT JOIN hurt USING (player_id, season, snapshot_date)),
  v AS (SELECT f.*, pts FROM f JOIN box USING (player_id, season, snapshot_date))"""


@query(
    "eligibility_factor",
    with_roles("box", more=_ELIG)
    + """SELECT player_id, season, snapshot_date, needed, avail, round(factor, 6) AS factor,
  round(CASE WHEN sum(pts * factor) OVER w > 0 THEN pts * factor / sum(pts * factor) OVER w ELSE pts / sum(pts) OVER w END, 6) AS share FROM v WINDOW w AS (PARTITION BY season, snapshot_date)""",
    dates=("snapshot_date",),
)
def eligibility_factor(spark, sf):
    """Chance of still playing enough games; every fifth player is hurt, and the empirical misses of the cell count."""
    key = ["player_id", "season", "snapshot_date"]
    rows = _qualifying(spark, sf).withColumn("needed", F.greatest(F.lit(0).cast("long"), NEEDED - (F.col("n_full") + F.least(F.lit(2).cast("long"), F.col("n_near")))))
    rows = rows.withColumn("avail", F.greatest(F.lit(0).cast("long"), GAMES - F.col("appeared"))).withColumn("p", pricing.clip(F.col("n_full") / F.col("appeared"), 0.02, 0.995))
    rows = rows.withColumn("status", F.element_at(F.array(*[F.lit(s) for s in _STATUS]), (F.col("player_id") % 4 + 1).cast("int")))
    samples = _samples(spark, sf)
    names = F.sort_array(F.collect_set("category"))
    samples = samples.crossJoin(samples.agg(names.alias("names")))  # nine categories at most
    samples = samples.select("status", (F.array_position("names", F.col("category")) - 1).alias("i"), F.size("names").alias("k"), "misses", "total")
    kinds = samples.agg(F.max("k").alias("kinds"))
    rows = rows.crossJoin(F.broadcast(kinds)).withColumn("i", F.when(F.col("player_id") % 5 == 0, F.col("player_id") % F.col("kinds")))
    rows = rows.join(F.broadcast(samples.drop("k")), ["status", "i"], "left")  # a row a cell

    needed, avail, p = F.col("needed"), F.col("avail"), F.col("p")
    factor = F.when((F.col("season") < 1993) | (needed == 0), 1.0).when(avail <= 0, 0.0)
    hurt = (F.col("player_id") % 5 == 0) & (F.col("status") != "probable")
    factor = factor.when(hurt, pricing.mixture_sf(needed, avail, p, F.col("misses"), F.col("total"))).otherwise(pricing.binomial_sf(needed, avail, p))
    rows = rows.withColumn("factor", factor).join(roles.box_asof(roles.game_log(spark, sf)).select(*key, "pts"), key)
    w = Window.partitionBy("season", "snapshot_date")
    gated = F.col("pts") * F.col("factor")
    share = F.when(F.sum(gated).over(w) > 0, gated / F.nullif(F.sum(gated).over(w), F.lit(0.0))).otherwise(F.col("pts") / F.sum("pts").over(w))
    return rows.select(*key, "needed", "avail", _r("factor").alias("factor"), _r(share).alias("share"))


@query(
    "fatigue_reweight",
    with_roles("box", "voting", more="""zs AS (SELECT b.player_id, b.season, CASE WHEN stddev_pop(pts) OVER w = 0 THEN 0 ELSE (pts - avg(pts) OVER w) / stddev_pop(pts) OVER w END AS zp,
     CASE WHEN stddev_pop(mpg) OVER w = 0 THEN 0 ELSE (mpg - avg(mpg) OVER w) / stddev_pop(mpg) OVER w END AS zm FROM box b JOIN grid g USING (season, snapshot_date)
     WHERE b.snapshot_date = (SELECT max(snapshot_date) FROM grid x WHERE x.season = b.season) WINDOW w AS (PARTITION BY b.season, b.snapshot_date)),
   z AS (SELECT player_id, season, (zp + zm) / 2 AS z FROM zs),
   top AS (SELECT DISTINCT player_id, season FROM voting WHERE rank <= 5),
   base AS (SELECT c.player_id, c.season, count(*) AS n, median(p.z) AS base FROM z c JOIN top t ON t.player_id = c.player_id AND t.season < c.season JOIN z p ON p.player_id = t.player_id AND p.season = t.season GROUP BY 1, 2),
   m AS (SELECT z.player_id, z.season, z.z, coalesce(n, 0) AS n, CASE WHEN n >= 1 THEN greatest(0.2, least(1, 1 - 0.1 * greatest(0, base - z.z) * power(n, 1.3))) ELSE 1 END AS mult FROM z LEFT JOIN base b USING (player_id, season))""")
    + "SELECT player_id, season, n AS prior_tops, round(mult, 6) AS multiplier, round(exp(z) * mult / sum(exp(z) * mult) OVER (PARTITION BY season), 6) AS share FROM m",
)
def fatigue_reweight(spark, sf):
    log = roles.game_log(spark, sf)
    key = ["season", "snapshot_date"]
    last = roles.grid(log).groupBy("season").agg(F.max("snapshot_date").alias("snapshot_date"))
    box = roles.box_asof(log).join(F.broadcast(last), key)
    composite = (F.coalesce(relative.zscore("pts", key), F.lit(0.0)) + F.coalesce(relative.zscore("mpg", key), F.lit(0.0))) / 2
    z = box.select("player_id", "season", composite.alias("z"))
    tops = roles.award_voting(log).filter("rank <= 5").select("player_id", "season").distinct().join(z, ["player_id", "season"]).select("player_id", F.col("season").alias("then"), F.col("z").alias("was"))
    base = z.join(tops, "player_id").filter("then < season").groupBy("player_id", "season").agg(F.count(F.lit(1)).alias("n"), F.median("was").alias("base"))
    rows = z.join(base, ["player_id", "season"], "left")
    decline = F.greatest(F.lit(0.0), F.col("base") - F.col("z"))
    mult = F.when(F.col("n") >= 1, pricing.clip(1 - 0.1 * decline * F.pow("n", F.lit(1.3)), 0.2, 1.0)).otherwise(1.0)
    weight = F.exp("z") * mult
    return rows.select("player_id", "season", F.coalesce("n", F.lit(0)).alias("prior_tops"), _r(mult).alias("multiplier"), _r(weight / F.sum(weight).over(Window.partitionBy("season"))).alias("share"))


_SIGNS = {"pts": 1, "mpg": 1, "gp": -1}


@query(
    "sign_aligned_composite",
    with_roles("box", more="f AS (SELECT player_id, season, snapshot_date, pts, CASE WHEN gp >= 5 THEN mpg END AS mpg, CASE WHEN player_id % 7 <> 0 THEN gp END AS gp FROM box), z AS (SELECT player_id, season, snapshot_date, "
    + ", ".join(f"CASE WHEN {c} IS NOT NULL AND count({c}) OVER w >= 2 THEN {sign} * CASE WHEN stddev_pop({c}) OVER w = 0 THEN 0 ELSE ({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w END END AS {c}" for c, sign in _SIGNS.items())
    + " FROM f WINDOW w AS (PARTITION BY season, snapshot_date))")
    + "SELECT player_id, season, snapshot_date, CAST((pts IS NOT NULL)::INT + (mpg IS NOT NULL)::INT + (gp IS NOT NULL)::INT AS INT) AS shared, round((coalesce(pts, 0) + coalesce(mpg, 0) + coalesce(gp, 0)) / nullif((pts IS NOT NULL)::INT + (mpg IS NOT NULL)::INT + (gp IS NOT NULL)::INT, 0), 6) AS composite FROM z",
    dates=("snapshot_date",),
)
def sign_aligned_composite(spark, sf):
    """Group z-scores turned so that more is better, averaged over the columns a row has; under two members there is none."""
    box = roles.box_asof(roles.game_log(spark, sf))
    rows = box.withColumn("mpg", F.when(F.col("gp") >= 5, F.col("mpg"))).withColumn("gp", F.when(F.col("player_id") % 7 != 0, F.col("gp")))
    w = Window.partitionBy("season", "snapshot_date")

    def aligned(c: str, sign: int):
        z = F.when(F.stddev_pop(c).over(w) == 0, 0.0).otherwise((F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_pop(c).over(w), F.lit(0.0)))
        return F.when(F.col(c).isNotNull() & (F.count(c).over(w) >= 2), sign * z)

    rows = rows.select("player_id", "season", "snapshot_date", *[aligned(c, s).alias(c) for c, s in _SIGNS.items()])
    shared = sum((F.col(c).isNotNull().cast("int") for c in _SIGNS), F.lit(0))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in _SIGNS), F.lit(0.0))
    return rows.select("player_id", "season", "snapshot_date", shared.alias("shared"), _r(total / F.nullif(shared, F.lit(0))).alias("composite"))
