"""Queries on effective prices, sizing rules and position ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pricing
from ..operators import asof, ledger
from . import markets, roles
from .registry import query
from .roles import with_roles


def _r(c, n=6):
    return F.round(c, n)


@query(
    "effective_prices",
    with_roles("ticks", more=markets._COST + ", l AS (SELECT *, event_id % 3 = 0 AS no, CASE WHEN event_id % 3 = 0 THEN 1 - price ELSE price END AS leg, spread * (1 + 0.35 * sqrt(size / depth)) AS cost FROM c)")
    + """SELECT event_id, round(leg * (1 + cost), 6) AS entry_price, round(greatest(leg * (1 - spread * (1 + 1.2 * 0.35 * sqrt(size / depth))), 0), 6) AS exit_price,
  round(greatest(1e-3, least(1 - 1e-3, leg)), 6) AS flat, round(greatest(1e-3, least(1 - 1e-3, leg)) * 1.02 * (1 + 0.5 * sqrt(size / 97.0)), 6) AS root,
  round(2 * spread * (1 + 0.35 * sqrt(greatest(abs(CASE WHEN no THEN -size ELSE size END), 1) / depth)), 6) AS turnover,
  round(CASE WHEN cost <= 0 THEN 30 ELSE greatest(1, least(30, greatest(price - 0.4, 1e-6) / (2 * cost))) END, 6) AS worth_steps FROM l""",
)
def effective_prices(spark, sf):
    """What buying and selling a leg yields, on the cost curve and on the two plain test curves."""
    price, size = F.col("price"), (F.lit(10) + F.col("event_id") % 500).cast("double")
    no = F.col("event_id") % 3 == 0
    leg = F.when(no, 1 - price).otherwise(price)
    cost = pricing.cost_fraction(price, size)
    toll = pricing.turnover(F.when(no, -size).otherwise(size), lambda s: pricing.cost_fraction(price, s))
    return roles.ticks(spark, sf).select(
        "event_id",
        _r(pricing.entry_price(leg, cost)).alias("entry_price"),
        _r(pricing.exit_price(leg, pricing.cost_fraction(price, size, leg="exit"))).alias("exit_price"),
        _r(pricing.flat_curve(leg)).alias("flat"),
        _r(pricing.root_curve(leg, size)).alias("root"),
        _r(toll).alias("turnover"),
        _r(pricing.worth_half_life(price - 0.4, 2 * cost)).alias("worth_steps"),
    )


@query(
    "gated_targets",
    with_roles("ticks", more=markets._SIG + ", g AS (SELECT *, 1 / (1 + 3.2 * sigma) AS fill, (candidate % 9) / 40e0 AS radj FROM sg)")
    + "SELECT candidate, round(fill, 6) AS fill, radj <= 0.05 AS gated, round(CASE WHEN radj <= 0.05 OR fill < 0.05 THEN 0 ELSE raw * fill END, 6) AS final FROM g",
)
def gated_targets(spark, sf):
    fill, radj = pricing.fill_fraction(F.col("sigma"), "inverse", 3.2), (F.col("candidate") % 9) / 40.0
    return markets._sigmas(spark, sf).select("candidate", _r(fill).alias("fill"), (radj <= 0.05).alias("gated"), _r(pricing.gated_fill(F.col("raw"), radj, fill)).alias("final"))


def _trades(spark, sf):
    """A trade for each event: buys, every fourth a sale of up to 15 shares, every 29th on the other side."""
    n = F.col("event_id")
    rows = roles.ticks(spark, sf)
    delta = F.when(n % 4 == 3, -(1 + n % 15)).otherwise(1 + n % 9)
    mid = F.col("price")
    eff = F.when(delta > 0, mid * 1.02).otherwise(mid * 0.98)
    side = F.when(n % 29 == 0, "NO").otherwise("YES")
    return rows.select("candidate", "ts", n.alias("event_id"), side.alias("side"), delta.alias("delta"), eff.alias("eff"), mid.alias("mid"), F.when(n % 5 != 0, F.least(F.lit(0.95), mid + 0.1)).alias("fair"))


@query("position_ledger")
def position_ledger(spark, sf):
    """All trades folded into positions, open ones and closed ones, with their average prices."""
    rows = ledger.fold(_trades(spark, sf), ["candidate"], ["ts", "event_id"])
    per = {f"vwap_{n}": F.try_divide(c, "bought") for n, c in (("eff", "cash_in"), ("mid", "mid_in"), ("fair", "fair_in"))}
    return rows.withColumns(per)


@query(
    "signed_holdings",
    with_roles("ticks", more="h AS (SELECT candidate, CASE WHEN candidate % 3 = 0 THEN 'NO' ELSE 'YES' END AS side, sum(CASE WHEN event_id % 4 = 3 THEN 0 ELSE 1 + event_id % 9 END) AS shares, arg_max(price, (ts, event_id)) AS price FROM ticks GROUP BY 1)")
    + "SELECT candidate, CAST(shares AS BIGINT) AS shares, round(CASE WHEN side = 'YES' THEN shares * price ELSE -shares * (1 - price) END, 6) AS signed_value FROM h",
)
def signed_holdings(spark, sf):
    """Outlays as signed dollars: below zero on the NO leg."""
    n = F.col("event_id")
    rows = roles.ticks(spark, sf).groupBy("candidate").agg(F.sum(F.when(n % 4 == 3, 0).otherwise(1 + n % 9)).alias("shares"), F.max_by("price", F.struct("ts", "event_id")).alias("price"))
    value = F.when(F.col("candidate") % 3 == 0, -F.col("shares") * (1 - F.col("price"))).otherwise(F.col("shares") * F.col("price"))
    return rows.select("candidate", "shares", _r(value).alias("signed_value"))


@query(
    "model_legs_at_exec",
    with_roles("scores", "ticks", more=f"""{markets._DAYS}, {markets._TICK}, {markets._FWD.format(n=7)}, mu AS (SELECT grp, candidate, list_avg(raw) AS mu FROM scores),
  snaps AS (SELECT candidate, day, 'oof_' || (1 + candidate % 2) || '_HELDOUT' AS version FROM days WHERE dayofweek(day) = 0),
  carried AS (SELECT d.candidate, d.day, max(s.day) AS snapshot FROM days d JOIN snaps s ON s.candidate = d.candidate AND s.day <= d.day AND s.version LIKE 'oof_1%' GROUP BY 1, 2)""")
    + "SELECT c.candidate, c.day, c.snapshot, round(m.mu, 6) AS score, round(f.fwd, 9) AS price FROM carried c JOIN fwd f ON f.candidate = c.candidate AND f.day = c.day JOIN mu m ON m.candidate = c.candidate WHERE f.fwd IS NOT NULL",
    dates=("day", "snapshot"),
)
def model_legs_at_exec(spark, sf):
    """Scores of one model version at the latest weekly snapshot up to each day, at the first price of the day after."""
    priced = markets._grid_prices(spark, sf, 6, None).filter("fwd is not null")
    version = F.concat(F.lit("oof_"), (1 + F.col("candidate") % 2).cast("string"), F.lit("_HELDOUT"))
    # a snapshot carries for seven days at most here, so the latest one is a date, not a join
    first = markets._days(spark, sf).groupBy("candidate").agg(F.min("day").alias("since"))
    snapshot = F.date_sub(F.col("day"), (F.dayofweek("day") - 1).cast("int"))
    mean = F.aggregate("raw", F.lit(0.0), lambda a, x: a + x) / F.size("raw")
    scores = roles.scores(spark, sf).select("candidate", mean.alias("mu"))
    rows = priced.join(first, "candidate").withColumn("snapshot", snapshot).filter((F.col("snapshot") >= F.col("since")) & version.like("oof_1%"))
    return rows.join(scores, "candidate").select("candidate", "day", "snapshot", _r("mu").alias("score"), _r("fwd", 9).alias("price"))


@query(
    "budget_asof",
    with_roles("daily", more="""b AS (SELECT candidate, day, round(100 * price, 4) AS budget FROM daily WHERE dayofmonth(day) IN (1, 10, 20))""")
    + "SELECT d.candidate, d.day, arg_max(b.budget, b.day) AS budget, max(b.day) AS since FROM daily d LEFT JOIN b ON b.candidate = d.candidate AND b.day <= d.day GROUP BY 1, 2",
    dates=("day", "since"),
)
def budget_asof(spark, sf):
    """The budget in force on each day: the last one set up to it."""
    days = roles.daily_prices(spark, sf)
    budgets = days.filter(F.dayofmonth("day").isin(1, 10, 20)).select("candidate", F.col("day").alias("since"), _r(100 * F.col("price"), 4).alias("budget"))
    return asof.latest(days.select("candidate", "day"), budgets, ["candidate"], "day", "since", ["since"], ["budget", "since"])
