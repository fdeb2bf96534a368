"""Queries on ledgers, equity and table upkeep."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import shared_dir, table
from ..sources import tables
from ..streaming import prices
from . import roles
from .registry import query
from .roles import with_roles


def _r(c, n=6):
    return F.round(c, n)


# Three books (event types), each a running sum of signed values, marked on their own days.
_BOOKS = ["purchase", "error", "view"]
_EQ = """flow AS (SELECT event_type AS book, CAST(ts AS DATE) AS day, sum(CAST(floor(value) AS BIGINT) * CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) AS f FROM events
    WHERE event_type IN ('purchase', 'error', 'view') GROUP BY 1, 2),
  eq AS (SELECT book, day, 50000 + sum(f) OVER (PARTITION BY book ORDER BY day) AS e FROM flow),
  days AS (SELECT DISTINCT day FROM eq), books AS (SELECT DISTINCT book FROM eq),
  filled AS (SELECT b.book, d.day, coalesce(last_value(e IGNORE NULLS) OVER w, first_value(e IGNORE NULLS) OVER (PARTITION BY b.book ORDER BY d.day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS e
    FROM books b CROSS JOIN days d LEFT JOIN eq USING (book, day) WINDOW w AS (PARTITION BY b.book ORDER BY d.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  pooled AS (SELECT 'pooled' AS book, day, sum(e) AS e FROM filled GROUP BY day UNION ALL SELECT book, day, e FROM filled),
  ret AS (SELECT book, day, e, CASE WHEN lag(e) OVER w = 0 THEN 0 ELSE (e - lag(e) OVER w) / lag(e) OVER w END::DOUBLE AS r, e / max(e) OVER w - 1 AS dd FROM pooled WINDOW w AS (PARTITION BY book ORDER BY day))"""


def _equity(spark, sf):
    """book, day, e: each book on every day of any, carried forward, and their sum."""
    sign = F.when(F.col("event_id") % 3 == 0, -1).otherwise(1)
    rows = table(spark, sf, "events").filter(F.col("event_type").isin(*_BOOKS))
    flow = rows.groupBy(F.col("event_type").alias("book"), F.to_date("ts").alias("day")).agg(F.sum(F.floor("value") * sign).alias("f"))
    eq = flow.select("book", "day", (50000 + F.sum("f").over(Window.partitionBy("book").orderBy("day"))).alias("e"))
    grid = eq.select("book").distinct().crossJoin(F.broadcast(eq.select("day").distinct()))
    by_day = Window.partitionBy("book").orderBy("day")
    carried = F.last("e", ignorenulls=True).over(by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.first("e", ignorenulls=True).over(by_day.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    filled = grid.join(eq, ["book", "day"], "left").select("book", "day", F.coalesce(carried, ahead).alias("e"))
    return filled.groupBy("day").agg(F.sum("e").alias("e")).select(F.lit("pooled").alias("book"), "day", "e").unionByName(filled)


@query(
    "equity_metrics",
    with_roles(more=_EQ)
    + """SELECT book, count(*) AS days, round(CASE WHEN stddev_samp(r) > 0 THEN sqrt(252) * avg(r) / stddev_samp(r) ELSE 0 END, 6) AS sharpe,
  round(CASE WHEN sqrt(avg(power(least(r, 0), 2)) FILTER (WHERE r IS NOT NULL)) > 0 THEN sqrt(252) * avg(r) / sqrt(avg(power(least(r, 0), 2)) FILTER (WHERE r IS NOT NULL)) ELSE 0 END, 6) AS sortino,
  round(min(dd), 6) AS max_drawdown, round(avg(r) / stddev_samp(r) FILTER (WHERE r < 0), 6) AS ledger_sortino FROM ret GROUP BY book""",
)
def equity_metrics(spark, sf):
    w = Window.partitionBy("book").orderBy("day")
    before = F.lag("e").over(w)
    rows = _equity(spark, sf).withColumn("r", F.when(before == 0, F.lit(0.0)).otherwise((F.col("e") - before) / F.nullif(before, F.lit(0))))
    rows = rows.withColumn("dd", F.col("e") / F.max("e").over(w) - 1)
    sd = F.stddev_samp("r")
    down = F.sqrt(F.avg(F.pow(F.least(F.col("r"), F.when(F.col("r").isNotNull(), 0.0)), F.lit(2))))
    year = 252.0**0.5
    return rows.groupBy("book").agg(
        F.count(F.lit(1)).alias("days"),
        _r(F.coalesce(F.when(sd > 0, year * F.avg("r") / F.nullif(sd, F.lit(0.0))), F.lit(0.0))).alias("sharpe"),
        _r(F.coalesce(F.when(down > 0, year * F.avg("r") / F.nullif(down, F.lit(0.0))), F.lit(0.0))).alias("sortino"),
        _r(F.min("dd")).alias("max_drawdown"),
        _r(F.avg("r") / F.stddev_samp(F.when(F.col("r") < 0, F.col("r")))).alias("ledger_sortino"),
    )


# A trade for each event of a user: every fourth is a trim of what came before.
_TR = """tr AS (SELECT user_id AS pid, event_id, ts, value / (value + 50e0) AS mid, (event_id % 4 = 3) AS trim, 1 + event_id % 9 AS shares FROM events WHERE event_type <> 'view'),
  agg AS (SELECT pid, sum(CASE WHEN NOT trim THEN shares END) AS bought, sum(CASE WHEN NOT trim THEN shares * mid END) AS at_mid, sum(CASE WHEN NOT trim THEN shares * mid * 1.02 END) AS cash_in,
     sum(CASE WHEN trim THEN shares * mid END) AS trim_mid, sum(CASE WHEN trim THEN shares * mid * 0.98 END) AS trim_cash, sum(CASE WHEN trim THEN shares END) AS trimmed, arg_max(mid, (ts, event_id)) AS last_mid FROM tr GROUP BY pid),
  pos AS (SELECT pid, bought, coalesce(trimmed, 0) AS trimmed, at_mid / bought AS m, cash_in / bought AS e, cash_in, coalesce(trim_mid, 0) AS trim_mid, coalesce(trim_cash, 0) AS trim_cash,
     least(0.95, last_mid + 0.1) AS fv, CASE WHEN pid % 4 = 0 THEN 1 ELSE 0 END AS settle, greatest(bought - coalesce(trimmed, 0), 0) AS held FROM agg WHERE bought > 0),
  att AS (SELECT *, trim_cash + held * settle - cash_in AS realised, bought * (fv - m) AS fve, bought * (m - e) - (trim_mid - trim_cash) AS cost, held * (settle - fv) AS osur FROM pos),
  res AS (SELECT *, realised - fve - cost - osur AS path FROM att)"""


def _attributed(spark, sf):
    rows = roles.ticks(spark, sf).filter("event_type <> 'view'").withColumn("trim", F.col("event_id") % 4 == 3).withColumn("shares", 1 + F.col("event_id") % 9)
    buy, trim = ~F.col("trim"), F.col("trim")
    n, mid = F.col("shares"), F.col("price")
    sums = rows.groupBy(F.col("candidate").alias("pid")).agg(
        F.sum(F.when(buy, n)).alias("bought"),
        F.sum(F.when(buy, n * mid)).alias("at_mid"),
        F.sum(F.when(buy, n * mid * 1.02)).alias("cash_in"),
        F.coalesce(F.sum(F.when(trim, n * mid)), F.lit(0.0)).alias("trim_mid"),
        F.coalesce(F.sum(F.when(trim, n * mid * 0.98)), F.lit(0.0)).alias("trim_cash"),
        F.coalesce(F.sum(F.when(trim, n)), F.lit(0)).alias("trimmed"),
        F.max_by("price", F.struct("ts", "event_id")).alias("last_mid"),
    )
    pos = sums.filter("bought > 0").withColumn("m", F.col("at_mid") / F.col("bought")).withColumn("e", F.col("cash_in") / F.col("bought"))
    pos = pos.withColumn("fv", F.least(F.lit(0.95), F.col("last_mid") + 0.1)).withColumn("settle", (F.col("pid") % 4 == 0).cast("int")).withColumn("held", F.greatest(F.col("bought") - F.col("trimmed"), F.lit(0)))
    att = pos.withColumn("realised", F.col("trim_cash") + F.col("held") * F.col("settle") - F.col("cash_in")).withColumn("fve", F.col("bought") * (F.col("fv") - F.col("m")))
    att = att.withColumn("cost", F.col("bought") * (F.col("m") - F.col("e")) - (F.col("trim_mid") - F.col("trim_cash"))).withColumn("osur", F.col("held") * (F.col("settle") - F.col("fv")))
    return att.withColumn("path", F.col("realised") - F.col("fve") - F.col("cost") - F.col("osur"))


@query("trade_attribution", with_roles(more=_TR) + "SELECT pid, CAST(bought AS BIGINT) AS bought, round(realised, 6) AS realised, round(fve, 6) AS fair_value_edge, round(cost, 6) AS cost_drag, round(osur, 6) AS outcome_surprise, round(path, 6) AS path_residual FROM res")
def trade_attribution(spark, sf):
    names = {"realised": "realised", "fve": "fair_value_edge", "cost": "cost_drag", "osur": "outcome_surprise", "path": "path_residual"}
    return _attributed(spark, sf).select("pid", "bought", *[_r(c).alias(n) for c, n in names.items()])


_VERDICT = """CASE WHEN fve IS NULL THEN 'UNATTRIBUTED' WHEN fve <= 0 THEN 'ENTRY_ERROR' WHEN held = 0 THEN CASE WHEN realised >= 0 THEN 'TRIM_WIN' ELSE 'TRIM_LOSS' END
  WHEN realised >= 0 THEN CASE WHEN fv < 0.30 THEN 'WIN_LOW_CONF' ELSE 'WIN_ON_THESIS' END
  WHEN osur <= cost AND osur <= path THEN CASE WHEN fv >= 0.55 THEN 'MODEL_MISS' WHEN fv < 0.30 THEN 'VARIANCE' ELSE 'MODEL_SOFT_MISS' END ELSE 'STRATEGY_COST' END"""


@query("verdicts", with_roles(more=_TR + f", v AS (SELECT *, {_VERDICT} AS verdict FROM res)") + "SELECT verdict, count(*) AS n, round(sum(realised), 4) AS realised FROM v GROUP BY verdict")
def verdicts(spark, sf):
    fv, lost = F.col("fv"), F.array_min(F.array(*[F.struct(F.col(c).alias("v"), F.lit(i).alias("i")) for i, c in enumerate(("osur", "cost", "path"))]))["i"]
    verdict = (
        F.when(F.col("fve").isNull(), "UNATTRIBUTED")
        .when(F.col("fve") <= 0, "ENTRY_ERROR")
        .when(F.col("held") == 0, F.when(F.col("realised") >= 0, "TRIM_WIN").otherwise("TRIM_LOSS"))
        .when(F.col("realised") >= 0, F.when(fv < 0.30, "WIN_LOW_CONF").otherwise("WIN_ON_THESIS"))
        .when(lost == 0, F.when(fv >= 0.55, "MODEL_MISS").when(fv < 0.30, "VARIANCE").otherwise("MODEL_SOFT_MISS"))
        .otherwise("STRATEGY_COST")
    )
    return _attributed(spark, sf).groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"), _r(F.sum("realised"), 4).alias("realised"))


@query(
    "book_summary",
    with_roles(more=_TR)
    + """SELECT pid % 3 AS book, count(*) AS positions, round(sum(realised), 4) AS pnl, round(100 * sum(realised) / sum(cash_in), 6) AS return_pct, round(avg((realised > 0)::INT), 6) AS win_rate,
  round(sum(fve), 4) AS fair_value_edge, round(sum(cost), 4) AS cost_drag, round(sum(osur), 4) AS outcome_surprise, round(sum(path), 4) AS path_residual,
  abs(sum(realised) - sum(fve) - sum(cost) - sum(osur) - sum(path)) < 1e-6 AS reconciled FROM res GROUP BY 1""",
)
def book_summary(spark, sf):
    """Each book's profit, return and win rate, and whether its attribution adds up."""
    parts = {"fve": "fair_value_edge", "cost": "cost_drag", "osur": "outcome_surprise", "path": "path_residual"}
    rows = _attributed(spark, sf).groupBy((F.col("pid") % 3).alias("book"))
    gap = F.sum("realised") - sum((F.sum(c) for c in parts), F.lit(0.0))
    return rows.agg(
        F.count(F.lit(1)).alias("positions"), _r(F.sum("realised"), 4).alias("pnl"), _r(100 * F.sum("realised") / F.sum("cash_in")).alias("return_pct"), _r(F.avg((F.col("realised") > 0).cast("int"))).alias("win_rate"),
        *[_r(F.sum(c), 4).alias(n) for c, n in parts.items()], (F.abs(gap) < 1e-6).alias("reconciled"),
    )


@query(
    "churn",
    with_roles(more=_TR + ", per AS (SELECT pid, count(*) AS n, sum(shares * mid) AS gross FROM tr GROUP BY pid)")
    + "SELECT CAST(sum(n) AS BIGINT) AS trades, round(sum(gross), 4) AS gross, count(*) AS names, CAST(median(n) AS DOUBLE) AS median_trades FROM per",
)
def churn(spark, sf):
    rows = roles.ticks(spark, sf).filter("event_type <> 'view'")
    per = rows.groupBy("candidate").agg(F.count(F.lit(1)).alias("n"), F.sum((1 + F.col("event_id") % 9) * F.col("price")).alias("gross"))
    return per.agg(F.sum("n").alias("trades"), _r(F.sum("gross"), 4).alias("gross"), F.count(F.lit(1)).alias("names"), F.median("n").alias("median_trades"))


@query(
    "upsert_latest",
    """WITH o AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, max(event_id) AS seen FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2),
 n AS (SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS seen FROM events WHERE event_id % 2 = 1 AND event_type <> 'view' GROUP BY 1, 2)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.user_id = o.user_id AND n.event_type = o.event_type)""",
)
def upsert_latest(spark, sf):
    events = table(spark, sf, "events")
    key = ["user_id", "event_type"]
    old = events.filter("event_id % 2 = 0").groupBy(*key).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("event_id").alias("seen"))
    new = events.filter("event_id % 2 = 1 and event_type <> 'view'").select(*key, "value", F.col("event_id").alias("seen"))
    return tables.upsert(old, new, key, ["seen"])


@query(
    "resume_worklist",
    """WITH done AS (SELECT CAST(year(o_orderdate) AS INT) AS season, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) % 2 = 0)
SELECT CAST(s AS INT) AS season FROM range(1992, 2003) t(s) WHERE NOT EXISTS (SELECT 1 FROM done WHERE season = s)""",
)
def resume_worklist(spark, sf):
    done = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("season")).agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 0").withColumn("pull_type", F.lit("logs"))
    return tables.work_list(spark, done, "logs", 1992, 2002)


@query(
    "fill_null_season",
    """WITH m AS (SELECT c_custkey AS market_id, CASE WHEN c_custkey % 2 = 0 THEN 1990 END AS season FROM customer),
 f AS (SELECT o_custkey AS market_id, min(o_orderdate) AS t FROM orders GROUP BY 1)
SELECT m.market_id, CAST(coalesce(season, year(t) - CASE WHEN month(t) >= 7 THEN 0 ELSE 1 END) AS INT) AS season FROM m LEFT JOIN f USING (market_id)""",
)
def fill_null_season(spark, sf):
    markets = table(spark, sf, "customer").select(F.col("c_custkey").alias("market_id"), F.when(F.col("c_custkey") % 2 == 0, 1990).alias("season"))
    first = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("market_id")).agg(F.min("o_orderdate").alias("t"))
    found = first.select("market_id", (F.year("t") - F.when(F.month("t") >= 7, 0).otherwise(1)).alias("season"))
    return tables.fill_null(markets, found, "market_id", "season")


@query(
    "stream_upsert",
    "SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2",
)
def stream_upsert(spark, sf):
    """The event table as a stream, folded into a keyed table batch by batch."""
    rows = prices.replay(spark, f"{sf}/events*.parquet", table(spark, sf, "events").schema)
    rows = rows.select("user_id", "event_type", "value", "event_id")
    folder = shared_dir(spark, "latest")
    started = prices.upsert_stream(rows, folder, ["user_id", "event_type"], ["event_id"], shared_dir(spark, "stream"))
    return prices.latest_version(spark, folder, started, rows.schema)
