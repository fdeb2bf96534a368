"""Positions as a fold over their trades, in order, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sums that a position carries while it is open.
CARRIED = ("shares", "bought", "cash_in", "mid_in", "fair_in", "trimmed", "trim_cash", "trim_mid")


def _empty(side: Column) -> Column:
    return F.struct(side.alias("side"), *[F.lit(0.0).alias(c) for c in CARRIED], F.lit(0).cast("long").alias("fills"))


def fold(trades: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a position that was opened: keys, number, side, closed, fills, its sums and its cash.

    trades: keys, order, side, delta (shares, below 0 sells), eff and mid (prices of the leg),
    fair (null if unknown). A buy of the other side while shares are held is refused: it
    changes nothing and is counted in ``refused`` of the position it met. A sale takes at most
    what is held; its cash counts in full, as the ledger's does. A position closes when no share
    is left, and the next trade opens another. The trades of one name are folded one after the
    other, as each depends on the last; names are independent of each other.
    """
    row = F.struct(*order, "side", *[F.col(c).cast("double").alias(c) for c in ("delta", "eff", "mid", "fair")])
    lists = trades.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("t"))
    open_ = F.struct(_empty(F.lit("")).alias("p"), F.lit(0.0).alias("cash"), F.lit(0).cast("long").alias("refused"))
    start = F.struct(open_.alias("now"), F.filter(F.array(open_), lambda x: F.lit(False)).alias("done"))

    def step(state: Column, t: Column) -> Column:
        now = state["now"]
        p = now["p"]
        flat = p["shares"] <= 1e-9
        side = F.when(flat, t["side"]).otherwise(p["side"])
        buys = t["delta"] > 0
        refused = ~flat & buys & (p["side"] != t["side"])
        idle = F.abs(t["delta"]) < 1e-12
        n = F.greatest(t["delta"], F.lit(0.0))
        cut = F.least(F.greatest(-t["delta"], F.lit(0.0)), p["shares"])
        moved = {
            "shares": p["shares"] + n - cut, "bought": p["bought"] + n, "cash_in": p["cash_in"] + n * t["eff"], "mid_in": p["mid_in"] + n * t["mid"],
            "fair_in": p["fair_in"] + n * F.coalesce(t["fair"], F.lit(0.0)), "trimmed": p["trimmed"] + cut, "trim_cash": p["trim_cash"] + cut * t["eff"], "trim_mid": p["trim_mid"] + cut * t["mid"],
        }
        still = refused | idle
        new = F.struct(
            F.struct(F.when(still, p["side"]).otherwise(side).alias("side"), *[F.when(still, p[c]).otherwise(x).alias(c) for c, x in moved.items()], F.when(still, p["fills"]).otherwise(p["fills"] + 1).alias("fills")).alias("p"),
            F.when(still, now["cash"]).otherwise(now["cash"] - t["delta"] * t["eff"]).alias("cash"),
            F.when(refused, now["refused"] + 1).otherwise(now["refused"]).alias("refused"),
        )
        closed = ~still & (new["p"]["shares"] <= 1e-9)
        return F.struct(F.when(closed, open_).otherwise(new).alias("now"), F.when(closed, F.concat(state["done"], F.array(new))).otherwise(state["done"]).alias("done"))

    folded = lists.select(*keys, F.aggregate("t", start, step).alias("s"))
    closed = F.transform(F.col("s.done"), lambda x: F.struct(x.alias("x"), F.lit(True).alias("closed")))
    last = F.filter(F.array(F.struct(F.col("s.now").alias("x"), F.lit(False).alias("closed"))), lambda x: x["x"]["p"]["fills"] > 0)
    rows = folded.select(*keys, F.posexplode(F.concat(closed, last)).alias("number", "r"))
    return rows.select(*keys, "number", "r.x.p.side", "r.closed", "r.x.p.fills", *[F.col(f"r.x.p.{c}") for c in CARRIED], "r.x.cash", "r.x.refused")
