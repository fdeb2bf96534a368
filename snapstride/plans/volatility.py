"""Queries on forward volatility: component models, their assembly, coverage and signed quantiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import pricing
from ..operators import quantiles
from ..session import shared_dir
from . import markets
from .registry import query
from .roles import with_roles

HORIZONS = (7, 14, 30)
GLM_HORIZONS = (2, 5, 10, 20, 30)
TERMS = ["one", "al", "al2", "ttr", "frac", "lh", "h", "al_lh", "frac_lh", "frac2", "fav", "fav_frac", "fav_al"]
RIDGE = 1.0
#: Example weights, so that the assembly's expression can be held against SQL; ``forward_vol_fit`` fits them.
EXAMPLE_GLM = [-0.4, 0.1, -0.02, 0.001, -0.3, -0.05, 0.002, 0.01, 0.02, 0.1, 0.05, 0.03, -0.01]
EXAMPLE_FADES = (0.0, 2.0, 0.0, 1.0)


def _r(c, n=6):
    return F.round(c, n)


# ---- points of series, t counted from 0

_POINTS = """pts AS (SELECT candidate, i - 1 AS t, n, price, z, s, abs(z) AS al, (i - 1) / (n - 1)::DOUBLE AS frac, n - i AS ttr, (price > 0.5)::INT AS fav FROM st)"""
_BASE = markets._STEPS + ", " + _POINTS


def _points(spark, sf):
    rows = markets._steps(spark, sf).withColumn("t", F.col("i") - 1)
    last = F.col("n") - 1
    return rows.select("candidate", "t", "n", "price", "z", "s", F.abs("z").alias("al"), (F.col("t") / last).alias("frac"), (last - F.col("t")).alias("ttr"), (F.col("price") > 0.5).cast("int").alias("fav"))


def _ahead(h: int):
    return Window.partitionBy("candidate").orderBy("t").rowsBetween(1, h)


def _targets(spark, sf, horizons, first: int, stride: int):
    """Points from ``first`` on, every ``stride``-th, by horizon: rms of the next h steps, where there are so many."""
    rows = _points(spark, sf)
    each = [F.struct(F.lit(h).alias("h"), F.sqrt(F.avg(F.col("s") * F.col("s")).over(_ahead(h))).alias("rv"), F.count("s").over(_ahead(h)).alias("k")) for h in horizons]
    rows = rows.withColumn("ahead", F.array(*each)).filter(F.col("t") >= first).filter(F.pmod(F.col("t") - first, F.lit(stride)) == 0)
    return rows.select("*", F.inline("ahead")).drop("ahead").filter("k = h and rv > 0")


def _targets_sql(horizons, first: int, stride: int) -> str:
    each = " UNION ALL ".join(f"SELECT *, {h} AS h, sqrt(avg(s * s) OVER w) AS rv, count(s) OVER w AS k FROM pts WINDOW w AS (PARTITION BY candidate ORDER BY t ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)" for h in horizons)
    return f"ahead AS (SELECT * FROM ({each}) WHERE k = h AND rv > 0 AND t >= {first} AND (t - {first}) % {stride} = 0)"


def basis(al, ttr, frac, h, fav) -> list:
    """The thirteen terms, as columns."""
    lh = F.ln(h)
    return [F.lit(1.0), al, al * al, ttr, frac, lh, h, al * lh, frac * lh, frac * frac, fav, fav * frac, fav * al]


_BASIS_SQL = "[1e0, al, al * al, ttr, frac, ln(h), h, al * ln(h), frac * ln(h), frac * frac, fav, fav * frac, fav * al]"


def _columns():
    return [F.col(c).cast("double") for c in ("al", "ttr", "frac", "h", "fav")]


def _sums(spark, sf):
    """Mean products of every two of the terms and the log target, and the number of points: one row."""
    rows = _targets(spark, sf, GLM_HORIZONS, 5, 4)
    rows = rows.select(F.array(*basis(*_columns()), F.ln("rv")).alias("x"))
    n = len(TERMS) + 1
    return rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col("x")[i] * F.col("x")[j]).alias(f"m_{i}_{j}") for i in range(n) for j in range(i, n)])


@query(
    "glm_moments",
    with_roles("daily", more=_BASE + ", " + _targets_sql(GLM_HORIZONS, 5, 4) + f", x AS (SELECT list_append({_BASIS_SQL}, ln(rv)) AS x FROM ahead), p AS (SELECT CAST(a.i AS INT) AS i, CAST(b.j AS INT) AS j FROM range({len(TERMS) + 1}) a(i) JOIN range({len(TERMS) + 1}) b(j) ON a.i <= b.j)")
    + "SELECT i, j, round(avg(x[i + 1] * x[j + 1]), 6) AS moment FROM x, p GROUP BY 1, 2",
)
def glm_moments(spark, sf):
    n = len(TERMS) + 1
    pairs = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), _r(F.col(f"m_{i}_{j}")).alias("moment")) for i in range(n) for j in range(i, n)]
    return _sums(spark, sf).select(F.inline(F.array(*pairs)))


def solve_glm(row, ridge: float = RIDGE) -> np.ndarray:
    """Weights of the terms from a row of ``_sums``: a 13 x 13 ridge solve."""
    k = len(TERMS)
    a = np.array([[row[f"m_{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)], float) * row["n"]
    return np.linalg.solve(a[:k, :k] + ridge * np.eye(k), a[:k, k])


def _glm_vol(weights, h=None):
    al, ttr, frac, own, fav = _columns()
    terms = basis(al, ttr, frac, own if h is None else F.lit(float(h)), fav)
    return F.exp(sum((F.lit(float(w)) * t for w, t in zip(weights, terms, strict=True)), F.lit(0.0)))


def _jumps(spark, sf):
    """Jump volatility by bin of abs logit: one row a bin."""
    far = F.lag("al").over(Window.partitionBy("candidate").orderBy("t"))
    jump = F.abs("s") > 0.5
    rows = _points(spark, sf).withColumn("bin", pricing.logit_bin(far)).filter("s is not null")
    mean_sq = F.coalesce(F.avg(F.when(jump, F.col("s") * F.col("s"))), F.lit(0.8**2))
    return rows.groupBy("bin").agg(F.sqrt(F.greatest(F.greatest(F.lit(1e-4), F.avg(jump.cast("int"))) * mean_sq, F.lit(1e-9))).alias("jump_vol"))


_BIN = "CASE WHEN {0} < 0.85 THEN 'centre' WHEN {0} < 2.2 THEN 'mid' ELSE 'extreme' END"
_JUMPS = "lagged AS (SELECT *, lag(al) OVER (PARTITION BY candidate ORDER BY t) AS far FROM pts), jumps AS (SELECT " + _BIN.format("far") + """ AS bin,
   sqrt(greatest(greatest(1e-4, avg((abs(s) > 0.5)::INT)) * coalesce(avg(s * s) FILTER (WHERE abs(s) > 0.5), 0.64), 1e-9)) AS jump_vol FROM lagged WHERE s IS NOT NULL GROUP BY 1)"""


def _parts(spark, sf, rows):
    """``rows`` of points with jump and own volatility; the trailing rms of ten steps stands for the series' own model.

    It needs twenty steps before it, as the conditional model does, and is null without them.
    """
    own = _points(spark, sf)
    before = Window.partitionBy("candidate").orderBy("t").rowsBetween(-9, 0)
    own = own.select("candidate", "t", F.when(F.col("t") >= 20, F.sqrt(F.avg(F.col("s") * F.col("s")).over(before))).alias("own_vol"))
    jumps = F.broadcast(_jumps(spark, sf))  # three rows
    return rows.join(own, ["candidate", "t"]).withColumn("bin", pricing.logit_bin(F.col("al"))).join(jumps, "bin", "left")


_PARTS = _JUMPS + """, own AS (SELECT candidate, t, CASE WHEN t >= 20 THEN sqrt(avg(s * s) OVER (PARTITION BY candidate ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) END AS own_vol FROM pts),
  parts AS (SELECT a.*, own_vol, jump_vol FROM ahead a JOIN own USING (candidate, t) LEFT JOIN jumps j ON j.bin = """ + _BIN.format("a.al") + ")"
_DOT = " + ".join(f"({w}) * x[{i + 1}]" for i, w in enumerate(EXAMPLE_GLM))
_FV = f""", volx AS (SELECT *, {_BASIS_SQL} AS x FROM parts), vol AS (SELECT *, exp({_DOT}) AS glm_vol, 1 / (1 + exp(-({EXAMPLE_FADES[0]} + {EXAMPLE_FADES[1]} * frac))) AS wf, 1 / (1 + exp(-({EXAMPLE_FADES[2]} + {EXAMPLE_FADES[3]} * al))) AS wp FROM volx),
  fv AS (SELECT * EXCLUDE (x), (1 - wf) * glm_vol + wf * CASE WHEN own_vol IS NULL THEN jump_vol ELSE wp * jump_vol + (1 - wp) * own_vol END AS fv FROM vol)"""


def _assembled(rows, glm=EXAMPLE_GLM, fades=EXAMPLE_FADES):
    fades = [F.lit(float(x)) for x in fades]
    return rows.withColumn("fv", pricing.assemble_vol(_glm_vol(glm), F.col("jump_vol"), F.col("own_vol"), F.col("frac"), F.col("al"), *fades))


@query(
    "vol_assembly",
    with_roles("daily", more=_BASE + ", " + _targets_sql(HORIZONS, 10, 8) + ", " + _PARTS + _FV) + "SELECT candidate, t, h, round(rv, 6) AS realised, round(fv, 6) AS forecast, round(greatest(rv, 1e-9) / greatest(fv, 1e-9) - ln(greatest(rv, 1e-9) / greatest(fv, 1e-9)) - 1, 6) AS qlike FROM fv",
)
def vol_assembly(spark, sf):
    """Cross-section, jump and own volatility in one forecast: jumps far from the centre, the own series late."""
    rows = _assembled(_parts(spark, sf, _targets(spark, sf, HORIZONS, 10, 8)))
    return rows.select("candidate", F.col("t").cast("long").alias("t"), "h", _r("rv").alias("realised"), _r("fv").alias("forecast"), _r(pricing.qlike(F.col("rv"), F.col("fv"))).alias("qlike"))


_CELL = _FV + """, reach AS (SELECT f.candidate, f.t, f.h, f.fv, f.price, f.frac, (SELECT max(abs(p.z - f.z)) FROM pts p WHERE p.candidate = f.candidate AND p.t BETWEEN f.t AND f.t + f.h) / greatest(f.fv * sqrt(f.h), 1e-9) AS ratio FROM fv f),
  cells AS (SELECT """ + "CASE WHEN price < 0.005 THEN 'centre' WHEN price < 0.03 THEN 'deep_lo' WHEN price < 0.1 THEN 'lo' WHEN price < 0.3 THEN 'mid_lo' WHEN price < 0.7 THEN 'centre' WHEN price < 0.9 THEN 'mid_hi' WHEN price < 0.97 THEN 'hi' WHEN price < 0.995 THEN 'deep_hi' ELSE 'centre' END AS tier, CASE WHEN frac < 0.33 THEN 'early' WHEN frac < 0.66 THEN 'mid' ELSE 'late' END AS band, h, ratio FROM reach)"


def _ratios(spark, sf):
    """Largest excursion over the forecast, by tier, season band and horizon."""
    rows = _points(spark, sf)
    both = [F.struct(F.lit(h).alias("h"), F.greatest(F.max("z").over(_ahead(h)) - F.col("z"), F.col("z") - F.min("z").over(_ahead(h)), F.lit(0.0)).alias("reach")) for h in HORIZONS]
    reach = rows.withColumn("both", F.array(*both)).select("candidate", "t", F.inline("both"))
    fv = _assembled(_parts(spark, sf, _targets(spark, sf, HORIZONS, 10, 8))).join(reach, ["candidate", "t", "h"])
    ratio = F.col("reach") / F.greatest(F.col("fv") * F.sqrt("h"), F.lit(1e-9))
    return fv.select(pricing.price_tier(F.col("price")).alias("tier"), pricing.season_band(F.col("frac")).alias("band"), "h", ratio.alias("ratio"))


@query(
    "coverage_cells",
    with_roles("daily", more=_BASE + ", " + _targets_sql(HORIZONS, 10, 8) + ", " + _PARTS + _CELL + ", cell AS (SELECT tier, band, h, count(*) AS n, quantile_cont(ratio, 0.8) AS q FROM cells GROUP BY 1, 2, 3), pool AS (SELECT quantile_cont(ratio, 0.8) AS q0 FROM cells)")
    + "SELECT tier, band, h, n, round(q, 6) AS q80, round(CASE WHEN n < 10 THEN q0 ELSE least(1, greatest(0, (n - 10) / 70e0)) * q + (1 - least(1, greatest(0, (n - 10) / 70e0))) * q0 END, 6) AS edge FROM cell, pool",
)
def coverage_cells(spark, sf):
    rows = _ratios(spark, sf)
    path = shared_dir(spark, "ratios")
    rows.write.parquet(path)  # read five times below
    rows = spark.read.parquet(path)
    key = ["tier", "band", "h"]
    cells = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).join(quantiles.percentile(rows, key, "ratio", 0.8, "q"), key)
    pooled = F.broadcast(quantiles.percentile(rows, [], "ratio", 0.8, "q0"))  # one row
    w = pricing.clip((F.col("n") - 10) / 70.0, 0.0, 1.0)
    edge = F.when(F.col("n") < 10, F.col("q0")).otherwise(w * F.col("q") + (1 - w) * F.col("q0"))
    return cells.crossJoin(pooled).select(*key, "n", _r("q").alias("q80"), _r(edge).alias("edge"))


# ---- signed quantiles of moves, by kernel weights around a point

#: Kernel bandwidths in season fraction and signed logit, least effective sample.
BANDWIDTH_FRAC, BANDWIDTH_Z, LEAST_EFFECTIVE = 0.12, 0.7, 15.0
SPOTS = [(f, p) for f in (0.2, 0.5, 0.8) for p in (0.15, 0.5, 0.85)]
ALPHA = 0.1


def _moves(spark, sf):
    """Every third point's largest rise and fall in the next h steps, or up to the series' end, and its net move."""
    rows = _points(spark, sf)
    up, down = (lambda h: F.greatest(F.coalesce(F.max("z").over(_ahead(h)) - F.col("z"), F.lit(0.0)), F.lit(0.0))), (lambda h: F.least(F.coalesce(F.min("z").over(_ahead(h)) - F.col("z"), F.lit(0.0)), F.lit(0.0)))
    each = [F.struct(F.lit(h).alias("h"), up(h).alias("up"), down(h).alias("down"), (F.last("z").over(_ahead(h)) - F.col("z")).alias("net")) for h in HORIZONS]
    rows = rows.withColumn("m", F.array(*each)).filter("t % 3 = 0 and ttr > 0")
    return rows.select("candidate", "t", "frac", "z", F.inline("m"))


_MOVES = ", ".join(["moves AS (" + " UNION ALL ".join(f"SELECT * FROM (SELECT candidate, t, frac, z, ttr, {h} AS h, greatest(max(z) OVER w - z, 0) AS up, least(min(z) OVER w - z, 0) AS down FROM pts WINDOW w AS (PARTITION BY candidate ORDER BY t ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)) WHERE t % 3 = 0 AND ttr > 0" for h in HORIZONS) + ")"])


@query(
    "signed_quantiles",
    with_roles("daily", more=_BASE + ", " + _MOVES + f""", spots AS (SELECT unnest({[f for f, _ in SPOTS]})::DOUBLE AS f0, unnest({[p for _, p in SPOTS]})::DOUBLE AS p0),
  w AS (SELECT f0, p0, h, up, down, exp(-0.5 * (power((frac - f0) / {BANDWIDTH_FRAC}, 2) + power((z - ln(p0 / (1 - p0))) / {BANDWIDTH_Z}, 2))) AS w FROM moves, spots),
  d AS (SELECT f0, p0, h, down, sum(w) AS w FROM w GROUP BY ALL), u AS (SELECT f0, p0, h, up, sum(w) AS w FROM w GROUP BY ALL),
  dc AS (SELECT *, sum(w) OVER (PARTITION BY f0, p0, h ORDER BY down) / sum(w) OVER (PARTITION BY f0, p0, h) AS c FROM d), uc AS (SELECT *, sum(w) OVER (PARTITION BY f0, p0, h ORDER BY up) / sum(w) OVER (PARTITION BY f0, p0, h) AS c FROM u),
  e AS (SELECT f0, p0, h, power(sum(w), 2) / sum(w * w) AS n_eff FROM w GROUP BY 1, 2, 3)""")
    + f"""SELECT e.f0 AS frac, e.p0 AS price, e.h, round(dq, 6) AS down, round(uq, 6) AS up, round(n_eff, 4) AS n_eff, n_eff < {LEAST_EFFECTIVE} AS thin FROM e
JOIN (SELECT f0, p0, h, min(down) AS dq FROM dc WHERE c >= {ALPHA} - 1e-12 GROUP BY 1, 2, 3) USING (f0, p0, h) JOIN (SELECT f0, p0, h, min(up) AS uq FROM uc WHERE c >= {1 - ALPHA} - 1e-12 GROUP BY 1, 2, 3) USING (f0, p0, h)""",
)
def signed_quantiles(spark, sf):
    """The alpha quantile of falls and of rises around nine points, and how many rows stand behind them."""
    spots = F.array(*[F.struct(F.lit(f).alias("f0"), F.lit(p).alias("p0")) for f, p in SPOTS])
    rows = _moves(spark, sf).select("*", F.inline(spots))
    far = F.pow((F.col("frac") - F.col("f0")) / BANDWIDTH_FRAC, F.lit(2)) + F.pow((F.col("z") - F.ln(F.col("p0") / (1 - F.col("p0")))) / BANDWIDTH_Z, F.lit(2))
    path = shared_dir(spark, "moves")
    rows.select("f0", "p0", "h", "up", "down", F.exp(-0.5 * far).alias("w")).write.parquet(path)
    rows, key = spark.read.parquet(path), ["f0", "p0", "h"]
    down = quantiles.weighted(rows, key, "down", "w", ALPHA, "down")
    up = quantiles.weighted(rows, key, "up", "w", 1 - ALPHA, "up").drop("n_eff")
    found = down.join(up, key)
    return found.select(F.col("f0").alias("frac"), F.col("p0").alias("price"), "h", _r("down").alias("down"), _r("up").alias("up"), _r("n_eff", 4).alias("n_eff"), (F.col("n_eff") < LEAST_EFFECTIVE).alias("thin"))


# ---- fits that SQL cannot express


def fit_fades(rows, starts=(EXAMPLE_FADES, (-1.0, 3.0, -1.0, 2.0)), rounds: int = 8) -> tuple[tuple, float]:
    """The four fade weights of least mean QLIKE, by pattern search.

    A round tries all 81 neighbours of the best point at one step size in a single pass over
    the points; the step is halved when none is better. Only 81 means reach the driver.
    rows: rv, glm_vol, jump_vol, own_vol, frac, al.
    """
    def losses(tries: list[tuple]) -> list[float]:
        spots = F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(float(v)).alias(f"x{i}") for i, v in enumerate(x)]) for k, x in enumerate(tries)])
        fv = pricing.assemble_vol(F.col("glm_vol"), F.col("jump_vol"), F.col("own_vol"), F.col("frac"), F.col("al"), *[F.col(f"x{i}") for i in range(4)])
        found = rows.select("*", F.inline(spots)).groupBy("k").agg(F.avg(pricing.qlike(F.col("rv"), fv)).alias("loss")).collect()
        by = {r.k: r.loss for r in found}
        return [by.get(k, float("inf")) for k in range(len(tries))]

    first = losses([tuple(s) for s in starts])
    best, loss = tuple(starts[int(np.argmin(first))]), float(min(first))
    step = 1.0
    for _ in range(rounds):
        around = [tuple(b + step * d for b, d in zip(best, move, strict=True)) for move in np.ndindex(3, 3, 3, 3)]
        around = [tuple(x - step for x in spot) for spot in around]
        found = losses(around)
        if min(found) < loss - 1e-9:
            best, loss = around[int(np.argmin(found))], float(min(found))
        else:
            step /= 2
    return best, loss


@query("forward_vol_fit")
def forward_vol_fit(spark, sf):
    """The cross-section's weights and the fades, fitted on all series: part, term, weight."""
    weights = solve_glm(_sums(spark, sf).first())
    path = shared_dir(spark, "vol-points")
    points = _parts(spark, sf, _targets(spark, sf, HORIZONS, 10, 8)).withColumn("glm_vol", _glm_vol(weights))
    points.select("rv", "glm_vol", "jump_vol", "own_vol", "frac", "al").write.parquet(path)
    fades, loss = fit_fades(spark.read.parquet(path))
    rows = [("glm", n, float(w)) for n, w in zip(TERMS, weights, strict=True)] + [("fade", n, float(w)) for n, w in zip(("frac_0", "frac_1", "price_0", "price_1"), fades, strict=True)] + [("fade", "loss", loss)]
    return spark.createDataFrame(rows, "part string, term string, weight double")
