"""Column expressions of prices, costs, fills and Kelly quantities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published fee schedule.
FEE_RATES = {"crypto": 0.07, "sports": 0.03, "finance": 0.04, "politics": 0.04, "economics": 0.05, "culture": 0.05, "weather": 0.05, "other": 0.05, "mentions": 0.04, "tech": 0.04, "geopolitics": 0.0}

#: Our own spread curve: price -> proportional half-spread, straight between knots.
KNOTS = ((0.05, 0.09), (0.10, 0.06), (0.25, 0.03), (0.50, 0.015), (0.75, 0.008), (0.95, 0.004))
CROSSOVER, CAP, FLOOR = 0.03, 0.10, 0.005
#: Upper bound of the price bucket -> dollars near the touch.
DEPTH = ((0.02, 40.0), (0.05, 80.0), (0.10, 150.0), (0.25, 300.0), (0.50, 600.0), (None, 900.0))
IMPACT = 0.35
# Depth multiplier and exit steepening of each liquidity regime.
REGIMES = {"illiquid": (0.25, 1.6), "normal": (1.0, 1.2), "liquid": (4.0, 1.0)}


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def logit(p: Column, eps: float = 0.005) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.ln(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (1 + F.exp(-z))


def steps(x: Column, bounds: list[tuple[float | None, object]]) -> Column:
    """The value of the first bound that x is below; None bounds all."""
    out = None
    for bound, value in reversed(bounds):
        out = F.lit(value) if bound is None else F.when(x < bound, F.lit(value)).otherwise(out)
    return out


def half_spread(price: Column) -> Column:
    """Monotone piecewise-linear spread: at the cap below the crossover, never under the floor."""
    curve = F.lit(KNOTS[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(KNOTS, KNOTS[1:]))):
        curve = F.when(price < x1, y0 + (y1 - y0) * (price - x0) / (x1 - x0)).otherwise(curve)
    curve = F.when(price <= KNOTS[0][0], F.lit(KNOTS[0][1])).otherwise(curve)
    return F.when(price < CROSSOVER, F.lit(CAP)).otherwise(clip(curve, FLOOR, CAP))


def cost_fraction(price: Column, size: Column, mode: str = "impact", regime: str = "normal", to_resolution: Column | None = None, decay: float = 0.6, leg: str = "entry") -> Column:
    """Cost of one leg as a share of notional: nothing, the spread, or the spread with impact."""
    if mode == "none":
        return F.lit(0.0)
    spread = half_spread(price)
    if mode == "spread":
        return spread
    depth, steepen = REGIMES[regime]
    scale = steps(price, list(DEPTH)) * depth
    if to_resolution is not None:
        scale = scale * F.greatest(F.lit(0.05), 1 - decay * to_resolution)
    extra = IMPACT * F.sqrt(F.greatest(size, F.lit(0.0)) / scale)
    return spread * (1 + extra * (steepen if leg == "exit" else 1.0))


def round_trip(price: Column, size: Column, **options) -> Column:
    return cost_fraction(price, size, leg="entry", **options) + cost_fraction(price, size, leg="exit", **options)


def fee_amount(notional: Column, price: Column, category: str = "sports") -> Column:
    """The fee to five places at any price; below the least amount there is none."""
    fee = F.round(notional * FEE_RATES[category] * (1 - price), 5)
    return F.when(fee < 1e-5, F.lit(0.0)).otherwise(fee)


def taker_fee(notional: Column, price: Column, category: str = "sports") -> Column:
    return F.when((price <= 0) | (price >= 1) | (notional <= 0), F.lit(0.0)).otherwise(fee_amount(notional, price, category))


def fill_fraction(sigma: Column, form: str = "inverse", k: float = 3.2, ceiling: float = 1.0, reference: float = 0.08) -> Column:
    shapes = {
        "inverse": lambda: F.lit(1.0) / (1 + k * sigma),
        "exp": lambda: F.exp(-k * sigma),
        "linear": lambda: 1 - k * sigma,
        "ref": lambda: reference / F.greatest(sigma, F.lit(1e-9)),
    }
    return clip(ceiling * shapes[form](), 0.0, ceiling)


def scaled_size(raw: Column, portfolio: float, sigma: Column, kelly: float = 0.5, sigma_ref: float = 0.12, soft_no: float = 0.12, soft_yes: float = 0.30) -> Column:
    """Half Kelly, rolled off by dispersion and by share of the book; under half a dollar: none."""
    by_vol = F.lit(1.0) / (1 + F.pow(sigma / sigma_ref, F.lit(2)))
    soft = F.when(raw < 0, F.lit(soft_no)).otherwise(F.lit(soft_yes))
    by_share = F.lit(1.0) / (1 + F.pow(F.abs(raw) / portfolio / soft, F.lit(2)))
    out = raw * kelly * by_vol * by_share
    return F.when(F.abs(out) < 0.5, F.lit(0.0)).otherwise(out)


def kelly_star(p: Column, b: Column) -> Column:
    """Best fraction of wealth at probability p and net odds b."""
    return clip((p * (b + 1) - 1) / b, 0.0, 1.0)


def growth_slope(f: Column, p: Column, b: Column) -> Column:
    """The first derivative of expected log growth."""
    return p * b / (1 + b * f) - (1 - p) / (1 - f)


def curvature(f: Column, p: Column, b: Column) -> Column:
    """Minus the second derivative of expected log growth."""
    return p * b * b / F.pow(1 + b * f, F.lit(2)) + (1 - p) / F.pow(1 - f, F.lit(2))


def project(target: Column, current: Column, width: Column) -> Column:
    """Hold inside the band around the target, else trade to its nearest edge."""
    gap = current - target
    return F.when(F.abs(gap) <= width, current).otherwise(target + F.signum(gap) * width)


def survival_weights(n: int, half_life: Column) -> Column:
    """Weights 0.5^((k - 1) / half-life) of 1..n steps, summing to 1."""
    raw = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.pow(F.lit(0.5), (k - 1) / half_life))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raw, lambda x: x / total)


def half_life(frac: Column) -> Column:
    """Steps to resolution at which half the path is left: 17 early, 9 late."""
    return 17.0 - 8.0 * clip(frac, 0.0, 1.0)


def _wait_terms(needed: Column, j: Column, log_term: Column, q: Column) -> Column:
    """From the log chance that the last needed success is trial j, that for trial j + 1."""
    return log_term + F.ln(q) + F.ln(j / (j + 1 - needed))


def binomial_sf(needed: Column, n: Column, p: Column) -> Column:
    """P(successes >= needed) of n trials, for any n.

    That is the chance that the last needed success comes at trial ``needed`` to n. The terms
    are all positive and each follows from the one before by a ratio, in logs, so nothing
    underflows or cancels.
    """
    q = 1 - p
    state = F.struct((needed * F.ln(p)).alias("term"), F.lit(0.0).alias("sum"))

    def add(s: Column, j: Column) -> Column:
        return F.struct(_wait_terms(needed, j, s["term"], q).alias("term"), (s["sum"] + F.exp(s["term"])).alias("sum"))

    over = F.aggregate(F.sequence(needed, F.greatest(n, needed)), state, add, lambda s: s["sum"])
    return F.when(needed <= 0, F.lit(1.0)).when(n < needed, F.lit(0.0)).when(p <= 0, F.lit(0.0)).when(p >= 1, F.lit(1.0)).otherwise(clip(over, 0.0, 1.0))


def mixture_sf(needed: Column, n: Column, p: Column, misses: Column, total: Column) -> Column:
    """Mean of binomial_sf(needed, n - miss, p) over a sample of misses.

    misses: how often each miss from 0 on is in the sample; ``total`` counts those, and the
    misses that never ended, which leave no trial. One walk over the trials serves all misses.
    """
    q = 1 - p
    state = F.struct((needed * F.ln(p)).alias("term"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("mix"))

    def add(s: Column, j: Column) -> Column:
        upto = s["sum"] + F.exp(s["term"])
        weight = F.coalesce(F.get(misses, (n - j).cast("int")), F.lit(0)).cast("double")
        return F.struct(_wait_terms(needed, j, s["term"], q).alias("term"), upto.alias("sum"), (s["mix"] + weight * upto).alias("mix"))

    mixed = F.aggregate(F.sequence(needed, F.greatest(n, needed)), state, add, lambda s: s["mix"]) / total
    return F.when(needed <= 0, F.lit(1.0)).when(n < needed, F.lit(0.0)).otherwise(mixed)


#: Price tiers by their upper ends, parts of a season, and bins of abs logit.
PRICE_TIERS = [(0.005, "centre"), (0.03, "deep_lo"), (0.10, "lo"), (0.30, "mid_lo"), (0.70, "centre"), (0.90, "mid_hi"), (0.97, "hi"), (0.995, "deep_hi"), (None, "centre")]
SEASON_BANDS = [(0.33, "early"), (0.66, "mid"), (None, "late")]
LOGIT_BINS = [(0.85, "centre"), (2.2, "mid"), (None, "extreme")]


def price_tier(price: Column) -> Column:
    return steps(price, PRICE_TIERS)


def season_band(frac: Column) -> Column:
    return steps(frac, SEASON_BANDS)


def logit_bin(far: Column) -> Column:
    return steps(far, LOGIT_BINS)


def qlike(realised: Column, forecast: Column) -> Column:
    """Realised over forecast, less its log, less one; both at least 1e-9."""
    ratio = F.greatest(realised, F.lit(1e-9)) / F.greatest(forecast, F.lit(1e-9))
    return ratio - F.ln(ratio) - 1


def assemble_vol(cross: Column, jump: Column, own: Column, frac: Column, al: Column, f0: Column, f1: Column, p0: Column, p1: Column) -> Column:
    """The cross-section's volatility fading into the series' own one late, and that into jumps far out."""
    late, out = sigmoid(f0 + f1 * frac), sigmoid(p0 + p1 * al)
    series = F.when(own.isNull(), jump).otherwise(out * jump + (1 - out) * own)
    return (1 - late) * cross + late * series


def entry_price(leg: Column, cost: Column) -> Column:
    """What a buyer pays on a leg, with the one-way cost as a fraction of the price."""
    return leg * (1 + cost)


def exit_price(leg: Column, cost: Column) -> Column:
    return F.greatest(leg * (1 - cost), F.lit(0.0))


def flat_curve(leg: Column) -> Column:
    """A leg's price at any size, kept inside (0, 1)."""
    return clip(leg, 1e-3, 1 - 1e-3)


def root_curve(leg: Column, size: Column, c: float = 0.5, near_touch: float = 97.0, spread: float = 0.02) -> Column:
    """A leg's price that grows with the root of the size."""
    return flat_curve(leg) * (1 + spread) * (1 + c * F.sqrt(F.greatest(size, F.lit(0.0)) / near_touch))


def turnover(current: Column, one_way, least: float = 1.0) -> Column:
    """Round-trip cost fraction of adjusting a position, by the curve at its own size."""
    return 2 * one_way(F.greatest(F.abs(current), F.lit(least)))


def worth_half_life(edge: Column, round_trip_cost: Column, low: float = 1.0, high: float = 30.0) -> Column:
    """Steps a position is worth holding for its edge, between low and high."""
    ratio = F.greatest(edge, F.lit(1e-6)) / F.nullif(round_trip_cost, F.lit(0.0))
    return F.when(round_trip_cost <= 0, F.lit(high)).otherwise(clip(ratio, low, high))


def gated_fill(target: Column, radj: Column, fill: Column, hurdle: float = 0.05, least: float = 0.05) -> Column:
    """A target times its fill, or nothing below the hurdle or the least fill."""
    return F.when((radj <= hurdle) | (fill < least), F.lit(0.0)).otherwise(target * fill)


def first_match(text: Column, rules: list[tuple[str, object]], default: str) -> Column:
    """The value of the first rule whose pattern (or column) holds."""
    conditions = [(text.rlike(rule) if isinstance(rule, str) else rule, value) for rule, value in rules]
    return reduce(lambda rest, cv: F.when(cv[0], F.lit(cv[1])).otherwise(rest), reversed(conditions), F.lit(default))
