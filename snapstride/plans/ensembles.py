"""Queries over raw ensemble scores: softmax, reductions, skill and contender sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relative
from . import roles
from .registry import query
from .roles import with_roles

K = 64
#: Names that a race's contenders are, by award (the group stands for it).
TOP_NAMES = (20, 15, 10)
_MU = "mus AS (SELECT *, list_avg(raw) AS mu FROM scores), shares AS (SELECT *, exp(mu - max(mu) OVER w) / sum(exp(mu)) OVER w * exp(max(mu) OVER w) AS vs FROM mus WINDOW w AS (PARTITION BY grp))"


def _r(c, n=6):
    return F.round(c, n)


def _mean(raw, n: int = K):
    return F.aggregate(F.slice(raw, 1, n), F.lit(0.0), lambda a, x: a + x) / n


def _mus(spark, sf):
    return roles.scores(spark, sf).withColumn("mu", _mean(F.col("raw")))


def _shares(spark, sf):
    return _mus(spark, sf).withColumn("vs", relative.softmax(F.col("mu"), ["grp"]))


def _draws(spark, sf):
    return roles.scores(spark, sf).select("grp", "candidate", "won", F.posexplode("raw").alias("k", "s"))


def _wins(spark, sf):
    """Per draw, the candidate with the highest score; the least candidate on ties."""
    return _draws(spark, sf).groupBy("grp", "k").agg(F.max_by("candidate", F.struct("s", -F.col("candidate"))).alias("candidate"))


def _p_win(spark, sf):
    counts = _wins(spark, sf).groupBy("grp", "candidate").agg((F.count(F.lit(1)) / K).alias("p_win"))
    return _shares(spark, sf).join(counts, ["grp", "candidate"], "left").withColumn("p_win", F.coalesce("p_win", F.lit(0.0)))


@query("grouped_softmax", with_roles("scores", more=_MU) + "SELECT grp, candidate, round(vs, 6) AS share, round(ln(vs), 6) AS log_share FROM shares")
def grouped_softmax(spark, sf):
    return _shares(spark, sf).select("grp", "candidate", _r("vs").alias("share"), _r(F.ln("vs")).alias("log_share"))


@query(
    "pl_gradient",
    with_roles("scores", more=_MU + ", lab AS (SELECT *, CASE WHEN won = 1 THEN 0.7 ELSE 0.3 / (count(*) OVER (PARTITION BY grp) - 1) END::DOUBLE AS y FROM shares)")
    + """SELECT grp, candidate, round(vs - y, 6) AS grad, round(greatest(vs * (1 - vs), 1e-3), 6) AS hess,
  round(-sum(y * ln(greatest(vs, 1e-300))) OVER (PARTITION BY grp), 6) AS loss FROM lab""",
)
def pl_gradient(spark, sf):
    w = Window.partitionBy("grp")
    rows = _shares(spark, sf).withColumn("y", F.when(F.col("won") == 1, F.lit(0.7)).otherwise(F.lit(0.3) / (F.count(F.lit(1)).over(w) - 1)))
    loss = -F.sum(F.col("y") * F.ln(F.greatest(F.col("vs"), F.lit(1e-300)))).over(w)
    hess = F.greatest(F.col("vs") * (1 - F.col("vs")), F.lit(1e-3))
    return rows.select("grp", "candidate", _r(F.col("vs") - F.col("y")).alias("grad"), _r(hess).alias("hess"), _r(loss).alias("loss"))


@query("softmax_of_mean", with_roles("scores", more=_MU) + "SELECT grp, candidate, round(mu, 6) AS mu, round(vs, 6) AS vote_share FROM shares")
def softmax_of_mean(spark, sf):
    return _shares(spark, sf).select("grp", "candidate", _r("mu").alias("mu"), _r("vs").alias("vote_share"))


@query(
    "mean_of_softmax",
    with_roles("draws", more="p AS (SELECT *, exp(s) / sum(exp(s)) OVER (PARTITION BY grp, k) AS p FROM draws)")
    + "SELECT grp, candidate, round(avg(p), 6) AS sizing_weight FROM p GROUP BY 1, 2",
)
def mean_of_softmax(spark, sf):
    rows = _draws(spark, sf).withColumn("p", relative.softmax(F.col("s"), ["grp", "k"]))
    return rows.groupBy("grp", "candidate").agg(_r(F.avg("p")).alias("sizing_weight"))


_PWIN = """wins AS (SELECT grp, k, arg_max(candidate, (s, -candidate)) AS candidate FROM draws GROUP BY 1, 2),
  pw AS (SELECT s.*, coalesce(c.n, 0) / 64e0 AS p_win FROM shares s
         LEFT JOIN (SELECT grp, candidate, count(*) AS n FROM wins GROUP BY 1, 2) c USING (grp, candidate))"""


@query("argmax_win_freq", with_roles("draws", more=_MU + ", " + _PWIN) + "SELECT grp, candidate, round(p_win, 6) AS p_win FROM pw")
def argmax_win_freq(spark, sf):
    return _p_win(spark, sf).select("grp", "candidate", _r("p_win").alias("p_win"))


@query(
    "ensemble_ci",
    with_roles("draws", more="p AS (SELECT *, exp(s) / sum(exp(s)) OVER (PARTITION BY grp, k) AS p FROM draws)")
    + """SELECT grp, candidate, round(avg(s), 6) AS mu, round(stddev_pop(s), 6) AS sigma,
  round(quantile_cont(p, 0.1), 6) AS ci_lo, round(quantile_cont(p, 0.9), 6) AS ci_hi FROM p GROUP BY 1, 2""",
)
def ensemble_ci(spark, sf):
    rows = _draws(spark, sf).withColumn("p", relative.softmax(F.col("s"), ["grp", "k"]))
    edges = [_r(F.percentile("p", F.lit(q))).alias(n) for q, n in ((0.1, "ci_lo"), (0.9, "ci_hi"))]
    return rows.groupBy("grp", "candidate").agg(_r(F.avg("s")).alias("mu"), _r(F.stddev_pop("s")).alias("sigma"), *edges)


@query("prefix_k_score", with_roles("scores") + "SELECT grp, candidate, round(list_avg(raw[1:8]), 6) AS k8, round(list_avg(raw[1:32]), 6) AS k32, round(list_avg(raw), 6) AS k64 FROM scores")
def prefix_k_score(spark, sf):
    return roles.scores(spark, sf).select("grp", "candidate", *[_r(_mean(F.col("raw"), k)).alias(f"k{k}") for k in (8, 32, 64)])


@query(
    "brier_skill",
    with_roles("scores", more=_MU + ", sq AS (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM shares)")
    + """SELECT grp, round(avg((vs - won) * (vs - won)), 6) AS brier, round(avg((1e0 / n - won) * (1e0 / n - won)), 6) AS base,
  round(1 - avg((vs - won) * (vs - won)) / nullif(avg((1e0 / n - won) * (1e0 / n - won)), 0), 6) AS skill,
  round(sqrt(avg((vs - won) * (vs - won))), 6) AS rmse FROM sq GROUP BY grp""",
)
def brier_skill(spark, sf):
    rows = _shares(spark, sf).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("grp")))
    sums = rows.groupBy("grp").agg(F.avg(F.pow(F.col("vs") - F.col("won"), F.lit(2))).alias("b"), F.avg(F.pow(F.lit(1.0) / F.col("n") - F.col("won"), F.lit(2))).alias("u"))
    return sums.select("grp", _r("b").alias("brier"), _r("u").alias("base"), _r(1 - F.col("b") / F.nullif(F.col("u"), F.lit(0.0))).alias("skill"), _r(F.sqrt("b")).alias("rmse"))


@query(
    "topk_accuracy",
    with_roles("scores", more=_MU + ", rk AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY vs DESC, candidate) AS r FROM shares)")
    + "SELECT count(*) AS races, round(avg((r <= 1)::INT), 6) AS top1, round(avg((r <= 3)::INT), 6) AS top3, round(avg((r <= 10)::INT), 6) AS top10, round(avg(r), 6) AS mean_rank FROM rk WHERE won = 1",
)
def topk_accuracy(spark, sf):
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.col("vs").desc(), "candidate"))
    rows = _shares(spark, sf).withColumn("r", rank).filter("won = 1")
    tops = [_r(F.avg((F.col("r") <= k).cast("int"))).alias(f"top{k}") for k in (1, 3, 10)]
    return rows.agg(F.count(F.lit(1)).alias("races"), *tops, _r(F.avg("r")).alias("mean_rank"))


@query(
    "accuracy_by_week_bucket",
    with_roles("box", "voting", more="""tops AS (SELECT season, snapshot_date, arg_max(player_id, (pts, -player_id)) AS pick FROM box GROUP BY 1, 2),
  winners AS (SELECT season, player_id FROM voting WHERE award = 'N' AND won = 1)""")
    + """SELECT CASE WHEN week_index IS NULL THEN 'unknown' WHEN week_index < 0 THEN 'preseason' WHEN week_index <= 3 THEN 'early' WHEN week_index <= 7 THEN 'mid' ELSE 'late' END AS bucket,
  count(*) AS races, round(avg((pick = player_id)::INT), 6) AS accuracy
FROM tops JOIN winners USING (season) JOIN grid USING (season, snapshot_date) GROUP BY 1""",
)
def accuracy_by_week_bucket(spark, sf):
    log = roles.game_log(spark, sf)
    picks = roles.box_asof(log).groupBy("season", "snapshot_date").agg(F.max_by("player_id", F.struct("pts", -F.col("player_id"))).alias("pick"))
    winners = roles.award_voting(log).filter("award = 'N' and won = 1").select("season", "player_id")
    rows = picks.join(F.broadcast(winners), "season").join(F.broadcast(roles.grid(log)), ["season", "snapshot_date"])
    week = F.col("week_index")
    bucket = F.when(week.isNull(), "unknown").when(week < 0, "preseason").when(week <= 3, "early").when(week <= 7, "mid").otherwise("late")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("races"), _r(F.avg((F.col("pick") == F.col("player_id")).cast("int"))).alias("accuracy"))


@query(
    "winner_true_rank",
    with_roles("scores", more=_MU) + "SELECT s.grp, s.candidate, (SELECT count(*) FROM shares o WHERE o.grp = s.grp AND o.vs > s.vs) + 1 AS rank FROM shares s WHERE won = 1",
)
def winner_true_rank(spark, sf):
    rows = _shares(spark, sf).withColumn("rank", F.rank().over(Window.partitionBy("grp").orderBy(F.col("vs").desc())).cast("long"))
    return rows.filter("won = 1").select("grp", "candidate", "rank")


@query(
    "contender_set_renorm",
    with_roles("scores", "ticks", more=_MU + """,
  market AS (SELECT candidate, avg(price) AS price FROM ticks GROUP BY 1),
  flags AS (SELECT s.*, row_number() OVER (PARTITION BY grp ORDER BY vs DESC, s.candidate) <= CASE grp % 3 WHEN 0 THEN 20 WHEN 1 THEN 15 ELSE 10 END AS rf, coalesce(m.price >= 0.4, false) AS mk,
                   s.candidate % 10 <> 3 AS tr FROM shares s LEFT JOIN market m USING (candidate)),
  sets AS (SELECT *, bool_or(rf AND mk) OVER (PARTITION BY grp) AS any_both FROM flags),
  chosen AS (SELECT *, (rf OR mk) AS s_union, CASE WHEN any_both THEN rf AND mk ELSE rf END AS s_both FROM sets)""")
    + """SELECT grp, candidate, CAST(s_union AND tr AS INT) AS allocated, CAST(s_both AS INT) AS in_both,
  round(CASE WHEN s_union THEN exp(mu) / sum(CASE WHEN s_union THEN exp(mu) END) OVER (PARTITION BY grp) ELSE 0 END, 6) AS union_share,
  round(CASE WHEN s_both THEN exp(mu) / sum(CASE WHEN s_both THEN exp(mu) END) OVER (PARTITION BY grp) ELSE 0 END, 6) AS both_share FROM chosen""",
)
def contender_set_renorm(spark, sf):
    w = Window.partitionBy("grp")
    market = roles.ticks(spark, sf).groupBy("candidate").agg(F.avg("price").alias("price"))
    rows = _shares(spark, sf).join(market, "candidate", "left")
    rank = F.row_number().over(w.orderBy(F.col("vs").desc(), "candidate"))
    names = F.element_at(F.array(*[F.lit(n) for n in TOP_NAMES]), (F.col("grp") % 3 + 1).cast("int"))
    rows = rows.withColumn("rf", rank <= names).withColumn("mk", F.coalesce(F.col("price") >= 0.4, F.lit(False))).withColumn("tr", F.col("candidate") % 10 != 3)
    both = F.col("rf") & F.col("mk")
    rows = rows.withColumn("s_union", F.col("rf") | F.col("mk")).withColumn("s_both", F.when(F.bool_or(both).over(w), both).otherwise(F.col("rf")))

    def share(s: str):
        e = F.when(F.col(s), F.exp("mu"))
        return _r(F.coalesce(e / F.sum(e).over(w), F.lit(0.0)))

    return rows.select("grp", "candidate", (F.col("s_union") & F.col("tr")).cast("int").alias("allocated"), F.col("s_both").cast("int").alias("in_both"), share("s_union").alias("union_share"), share("s_both").alias("both_share"))


@query(
    "peak_floor",
    with_roles("draws", more=_MU + ", " + _PWIN + """,
  un AS (SELECT *, vs AS v, p_win / sum(p_win) OVER (PARTITION BY grp) AS f,
                row_number() OVER (PARTITION BY grp ORDER BY vs DESC, candidate) AS r FROM pw),
  js AS (SELECT *, 1 - (0.5 * sum(CASE WHEN f > 0 THEN f * log2(f / (0.5 * (f + v))) ELSE 0 END) OVER (PARTITION BY grp)
                      + 0.5 * sum(v * log2(v / (0.5 * (f + v)))) OVER (PARTITION BY grp)) AS w FROM un),
  pk AS (SELECT *, max(CASE WHEN r = 1 THEN greatest(v, w * f + (1 - w) * v) END) OVER (PARTITION BY grp) AS peak,
                   max(CASE WHEN r = 1 THEN v END) OVER (PARTITION BY grp) AS top FROM js)""")
    + "SELECT grp, candidate, round(w, 6) AS weight, round(CASE WHEN r = 1 THEN peak ELSE v * (1 - peak) / nullif(1 - top, 0) END, 6) AS floored FROM pk",
)
def peak_floor(spark, sf):
    w = Window.partitionBy("grp")
    rows = _p_win(spark, sf).withColumn("v", F.col("vs")).withColumn("f", F.col("p_win") / F.sum("p_win").over(w))
    rows = rows.withColumn("r", F.row_number().over(w.orderBy(F.col("vs").desc(), "candidate"))).withColumn("m", 0.5 * (F.col("f") + F.col("v")))
    left = F.sum(F.when(F.col("f") > 0, F.col("f") * F.log2(F.col("f") / F.col("m"))).otherwise(0.0)).over(w)
    right = F.sum(F.col("v") * F.log2(F.col("v") / F.col("m"))).over(w)
    rows = rows.withColumn("w", 1 - (0.5 * left + 0.5 * right))
    lifted = F.greatest(F.col("v"), F.col("w") * F.col("f") + (1 - F.col("w")) * F.col("v"))
    rows = rows.withColumn("peak", F.max(F.when(F.col("r") == 1, lifted)).over(w)).withColumn("top", F.max(F.when(F.col("r") == 1, F.col("v"))).over(w))
    floored = F.when(F.col("r") == 1, F.col("peak")).otherwise(F.col("v") * (1 - F.col("peak")) / F.nullif(1 - F.col("top"), F.lit(0.0)))
    return rows.select("grp", "candidate", _r("w").alias("weight"), _r(floored).alias("floored"))


@query(
    "winner_state_wealth",
    with_roles("scores", more=_MU + """,
  bets AS (SELECT *, CASE WHEN candidate % 3 = 0 THEN -1 ELSE 1 END AS side, 20 + candidate % 7 AS stake,
                  greatest(0.02, least(0.9, vs * 5)) AS price FROM shares),
  legs AS (SELECT *, stake / CASE WHEN side > 0 THEN price ELSE 1 - price END AS n FROM bets),
  wealth AS (SELECT *, 10000 - sum(stake) OVER (PARTITION BY grp) + CASE WHEN side > 0 THEN n ELSE 0 END
                 + coalesce(sum(CASE WHEN side < 0 THEN n END) OVER (PARTITION BY grp), 0) - CASE WHEN side < 0 THEN n ELSE 0 END AS w FROM legs)""")
    + "SELECT grp, candidate, round(w, 6) AS wealth, round(sum(vs * ln(w / 10000)) OVER (PARTITION BY grp), 9) AS growth FROM wealth",
)
def winner_state_wealth(spark, sf):
    w = Window.partitionBy("grp")
    rows = _shares(spark, sf).withColumn("yes", F.col("candidate") % 3 != 0).withColumn("stake", 20 + F.col("candidate") % 7)
    rows = rows.withColumn("price", F.greatest(F.lit(0.02), F.least(F.lit(0.9), F.col("vs") * 5)))
    rows = rows.withColumn("n", F.col("stake") / F.when(F.col("yes"), F.col("price")).otherwise(1 - F.col("price")))
    no = F.coalesce(F.sum(F.when(~F.col("yes"), F.col("n"))).over(w), F.lit(0.0))
    own = F.when(F.col("yes"), F.col("n")).otherwise(-F.col("n"))
    rows = rows.withColumn("w", 10000 - F.sum("stake").over(w) + no + own)
    return rows.select("grp", "candidate", _r("w").alias("wealth"), _r(F.sum(F.col("vs") * F.ln(F.col("w") / 10000)).over(w), 9).alias("growth"))


@query(
    "book_budget",
    with_roles("scores", more=_MU + """, sk AS (SELECT grp, count(*) AS n, 1 - avg((vs - won) * (vs - won)) / nullif((1 - 1e0 / count(*)) / count(*), 0) AS skill FROM shares GROUP BY grp),
  fl AS (SELECT grp, greatest(0, 0.2 + 100 * skill) AS s FROM sk),
  raw AS (SELECT grp, CASE WHEN sum(s) OVER () > 0 THEN s / sum(s) OVER () ELSE 1e0 / count(*) OVER () END AS raw, count(*) OVER () AS k FROM fl)""")
    + "SELECT grp, round(raw, 6) AS raw_weight, round(0.5 / k + 0.5 * raw, 6) AS weight, CAST(round_even(3000 * (0.5 / k + 0.5 * raw), 0) AS BIGINT) AS budget FROM raw",
)
def book_budget(spark, sf):
    every = Window.partitionBy(F.lit(0))  # one row a book
    n = F.count(F.lit(1))
    books = _shares(spark, sf).groupBy("grp").agg((1 - F.avg(F.pow(F.col("vs") - F.col("won"), F.lit(2))) / F.nullif((1 - F.lit(1.0) / n) / n, F.lit(0.0))).alias("skill"))
    books = books.withColumn("s", F.greatest(F.lit(0.0), 0.2 + 100 * F.col("skill")))
    total, k = F.sum("s").over(every), F.count(F.lit(1)).over(every)
    books = books.withColumn("raw", F.when(total > 0, F.col("s") / F.nullif(total, F.lit(0.0))).otherwise(F.lit(1.0) / k)).withColumn("weight", F.lit(0.5) / k + 0.5 * F.col("raw"))
    return books.select("grp", _r("raw").alias("raw_weight"), _r("weight").alias("weight"), F.bround(3000 * F.col("weight")).cast("long").alias("budget"))


# ---- sets and reweights applied to the whole cloud of draws

_CLOUD = _MU + """,
  flags AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY vs DESC, candidate) <= CASE grp % 3 WHEN 0 THEN 20 WHEN 1 THEN 15 ELSE 10 END AS rf, CASE WHEN candidate % 11 = 0 THEN 0e0 ELSE 0.5 + (candidate % 4) / 4e0 END AS rw, candidate % 10 <> 3 AS tr FROM shares),
  inset AS (SELECT *, rf AND rw > 0 AS ins FROM flags),
  cloud AS (SELECT d.grp, d.candidate, d.k, i.vs, i.tr, i.ins, CASE WHEN i.ins THEN d.s + ln(i.rw) ELSE -1e9 END AS s FROM draws d JOIN inset i USING (grp, candidate)),
  soft AS (SELECT *, exp(s - max(s) OVER (PARTITION BY grp, k)) AS e FROM cloud),
  q AS (SELECT *, e / sum(e) OVER (PARTITION BY grp, k) AS p FROM soft),
  red AS (SELECT grp, candidate, any_value(vs) AS vs, any_value(tr) AS tr, any_value(ins) AS ins, avg(s) AS m, avg(p) AS sizing, var_pop(s) AS spread FROM q GROUP BY 1, 2),
  fin AS (SELECT *, exp(m - max(m) OVER (PARTITION BY grp)) AS e FROM red),
  fin2 AS (SELECT *, CASE WHEN ins THEN e / sum(e) OVER (PARTITION BY grp) ELSE 0 END AS share FROM fin)"""

#: Rows outside a set stay finite, so that no reduction meets a NaN.
MASKED = -1e9


def _masked_cloud(spark, sf):
    """grp, candidate, vs, tr, ins, cloud: draws shifted by the log of their factor, masked outside the set."""
    w = Window.partitionBy("grp")
    names = F.element_at(F.array(*[F.lit(n) for n in TOP_NAMES]), (F.col("grp") % 3 + 1).cast("int"))
    rows = _shares(spark, sf).withColumn("rf", F.row_number().over(w.orderBy(F.col("vs").desc(), "candidate")) <= names)
    factor = F.when(F.col("candidate") % 11 == 0, 0.0).otherwise(0.5 + (F.col("candidate") % 4) / 4.0)
    rows = rows.withColumn("rw", factor).withColumn("ins", F.col("rf") & (factor > 0)).withColumn("tr", F.col("candidate") % 10 != 3)
    shift = F.ln("rw")
    cloud = F.transform("raw", lambda x: F.when(F.col("ins"), x + shift).otherwise(F.lit(MASKED)))
    return rows.select("grp", "candidate", "vs", "tr", "ins", cloud.alias("cloud"))


def _reduced(rows):
    """Both reductions of a cloud, zero outside the set: softmax of the mean and mean of the softmax."""
    rows = rows.withColumn("m", _mean(F.col("cloud")))
    draws = rows.select("grp", "candidate", F.posexplode("cloud").alias("k", "s")).withColumn("p", relative.softmax(F.col("s"), ["grp", "k"]))
    sizing = draws.groupBy("grp", "candidate").agg(F.avg("p").alias("sizing"))
    rows = rows.withColumn("share", F.when(F.col("ins"), relative.softmax(F.col("m"), ["grp"])).otherwise(0.0))
    return rows.join(sizing, ["grp", "candidate"]).withColumn("sizing", F.when(F.col("ins"), F.col("sizing")).otherwise(0.0))


@query(
    "masked_cloud_renorm",
    with_roles("draws", more=_CLOUD) + "SELECT grp, candidate, round(share, 6) AS share, round(CASE WHEN ins THEN sizing ELSE 0 END, 6) AS sizing, CAST(ins AND tr AS INT) AS allocated, share > 0.5 AND vs > 1e-6 AND share / vs > 3 AS tripwire FROM fin2",
)
def masked_cloud_renorm(spark, sf):
    """Factors as log shifts, names outside the set masked, both reductions anew, and a wire for mass that moves to one name."""
    rows = _reduced(_masked_cloud(spark, sf))
    wire = (F.col("share") > 0.5) & (F.col("vs") > 1e-6) & (F.col("share") / F.col("vs") > 3)
    return rows.select("grp", "candidate", _r("share").alias("share"), _r("sizing").alias("sizing"), (F.col("ins") & F.col("tr")).cast("int").alias("allocated"), wire.alias("tripwire"))


@query(
    "peak_shifted_cloud",
    with_roles("draws", more=_CLOUD + """, pk AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY share DESC, candidate) AS r FROM fin2 WHERE ins),
  lift AS (SELECT *, CASE WHEN r = 1 THEN share + 0.5 * (1 - share) ELSE share * 0.5 END AS aim FROM pk)""")
    + "SELECT grp, candidate, round(ln(greatest(aim, 1e-300)) - m, 6) AS delta, round(aim, 6) AS share, round(spread, 6) AS variance FROM lift",
)
def peak_shifted_cloud(spark, sf):
    """A new point reached by one constant for each row of the cloud: its mean moves, its variance stays."""
    rows = _masked_cloud(spark, sf).filter("ins").withColumn("m", _mean(F.col("cloud")))
    rows = rows.withColumn("share", relative.softmax(F.col("m"), ["grp"]))
    first = F.row_number().over(Window.partitionBy("grp").orderBy(F.col("share").desc(), "candidate")) == 1
    aim = F.when(first, F.col("share") + 0.5 * (1 - F.col("share"))).otherwise(F.col("share") * 0.5)
    rows = rows.withColumn("aim", aim).withColumn("delta", F.ln(F.greatest(F.col("aim"), F.lit(1e-300))) - F.col("m"))
    moved = F.transform("cloud", lambda x: x + F.col("delta"))
    rows = rows.withColumn("moved", moved).withColumn("mm", _mean(F.col("moved")))
    back = relative.softmax(F.col("mm"), ["grp"])
    variance = F.aggregate("moved", F.lit(0.0), lambda a, x: a + (x - F.col("mm")) * (x - F.col("mm"))) / F.size("moved")
    return rows.select("grp", "candidate", _r("delta").alias("delta"), _r(back).alias("share"), _r(variance).alias("variance"))


_CONTEND = """lab AS (SELECT grp, candidate, won, vs, candidate % 17 = grp % 17 AS voted FROM shares),
  cnt AS (SELECT *, count(*) FILTER (WHERE voted) OVER (PARTITION BY grp) AS nv, row_number() OVER (PARTITION BY grp ORDER BY vs DESC, candidate) AS r FROM lab),
  con AS (SELECT * FROM cnt WHERE CASE WHEN nv >= 2 THEN voted ELSE r <= 5 END),
  bs AS (SELECT grp, avg((vs - won) * (vs - won)) AS brier, var_pop(won) AS base FROM con GROUP BY 1),
  sk AS (SELECT b.grp, CASE WHEN base > 0 THEN 1 - brier / base END AS skill FROM (SELECT DISTINCT grp FROM lab) g JOIN bs b USING (grp))"""


@query(
    "contender_skill",
    with_roles("scores", more=_MU + ", " + _CONTEND)
    + "SELECT grp, round(skill, 6) AS skill, round(avg(skill) OVER (ORDER BY grp ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 6) AS trailing FROM sk",
)
def contender_skill(spark, sf):
    """Brier skill among those with a vote, or the five likeliest where fewer than two have one, and its trailing mean."""
    w = Window.partitionBy("grp")
    rows = _shares(spark, sf).withColumn("voted", F.col("candidate") % 17 == F.col("grp") % 17)
    rows = rows.withColumn("nv", F.count_if("voted").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.col("vs").desc(), "candidate")))
    among = rows.filter(F.when(F.col("nv") >= 2, F.col("voted")).otherwise(F.col("r") <= 5))
    sums = among.groupBy("grp").agg(F.avg(F.pow(F.col("vs") - F.col("won"), F.lit(2))).alias("brier"), F.var_pop("won").alias("base"))
    skill = sums.select("grp", F.when(F.col("base") > 0, 1 - F.col("brier") / F.nullif(F.col("base"), F.lit(0.0))).alias("skill"))
    before = Window.partitionBy(F.lit(0)).orderBy("grp").rowsBetween(-10, -1)  # one row a race
    return skill.select("grp", _r("skill").alias("skill"), _r(F.avg("skill").over(before)).alias("trailing"))


@query(
    "autopsy_rows",
    with_roles("scores", more=_MU + ", rk AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY vs DESC, candidate) AS r FROM shares), v AS (SELECT grp, max(r) FILTER (WHERE won = 1) AS wr, max(vs) FILTER (WHERE won = 1) AS p FROM rk GROUP BY 1)")
    + "SELECT v.grp, v.wr AS winner_rank, round(v.p, 6) AS winner_share, CASE WHEN wr = 1 THEN 'hit' WHEN wr <= 3 THEN 'near' ELSE 'miss' END AS verdict, r AS place, candidate, round(vs, 6) AS share FROM v JOIN rk USING (grp) WHERE wr > 3 AND r <= 3",
)
def autopsy_rows(spark, sf):
    """For each race whose winner was not among the first three, who was."""
    rows = _shares(spark, sf).withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy(F.col("vs").desc(), "candidate")).cast("long"))
    won = F.col("won") == 1
    races = rows.groupBy("grp").agg(F.max(F.when(won, F.col("r"))).alias("winner_rank"), F.max(F.when(won, F.col("vs"))).alias("p"))
    verdict = F.when(F.col("winner_rank") == 1, "hit").when(F.col("winner_rank") <= 3, "near").otherwise("miss")
    missed = races.filter("winner_rank > 3").select("grp", "winner_rank", _r("p").alias("winner_share"), verdict.alias("verdict"))
    return missed.join(rows.filter("r <= 3").select("grp", F.col("r").alias("place"), "candidate", _r("vs").alias("share")), "grp")
