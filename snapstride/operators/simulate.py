"""Sequential and numeric kernels: joint samples, volatility, portfolio solve, daily fold."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import seed_of
from .region import Region

MIN_TICKET = 15.0


def joint_samples(rows: DataFrame, *, group: list[str], key: str, raw: str, frac: str, draws: int = 200, slope: float = -1.0, intercept: float = -2.0, df_early: float = 4.0, df_late: float = 12.0, seed: int = 3) -> DataFrame:
    """group, key, p_win, sizing_weight, sim_mean, sim_sd over K raw scores times ``draws`` noises.

    Noise is Student-t, its scale exp(slope * frac + intercept) and its degrees of freedom
    moving with frac. The cloud of a race lives in one task and only its reductions leave it.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*group, key]) + ", p_win double, sizing_weight double, sim_mean double, sim_sd double"

    def run(race: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(key, kind="stable")
        scores = np.stack(part[raw].to_numpy()).astype(float)
        f = float(part[frac].iloc[0])
        rng = np.random.default_rng(seed_of(seed, *race))
        df = max(df_early + (df_late - df_early) * f, 2.1)
        n, k = scores.shape
        win, share, total, square = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        for j in range(k):  # one raw score at a time keeps the cloud at n x draws
            sim = scores[:, j, None] + rng.standard_t(df, (n, draws)) * np.exp(slope * f + intercept)
            win += np.bincount(sim.argmax(axis=0), minlength=n)
            e = np.exp(sim - sim.max(axis=0))
            share += (e / e.sum(axis=0)).sum(axis=1)
            total += sim.sum(axis=1)
            square += (sim**2).sum(axis=1)
        m = k * draws
        sd = np.sqrt(np.maximum(square / m - (total / m) ** 2, 0))
        return part[[*group, key]].assign(p_win=win / m, sizing_weight=share / m, sim_mean=total / m, sim_sd=sd)

    return rows.groupBy(*group).applyInPandas(run, schema)


def bootstrap_wins(rows: DataFrame, *, group: list[str], key: str, raw: str, resamples: int = 200, seed: int = 13) -> DataFrame:
    """group, key, p_win, lo, hi: 10th and 90th percentile over resamples of the K members."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*group, key]) + ", p_win double, lo double, hi double"

    def run(race: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(key, kind="stable")
        scores = np.stack(part[raw].to_numpy()).astype(float)
        n, k = scores.shape
        winner = scores.argmax(axis=0)
        rng = np.random.default_rng(seed_of(seed, *race))
        drawn = winner[rng.integers(0, k, (resamples, k))]
        shares = np.stack([np.bincount(d, minlength=n) / k for d in drawn])
        lo, hi = np.quantile(shares, [0.1, 0.9], axis=0)
        return part[[*group, key]].assign(p_win=np.bincount(winner, minlength=n) / k, lo=lo, hi=hi)

    return rows.groupBy(*group).applyInPandas(run, schema)


def nelder_mead(f, start: np.ndarray, step: float = 0.5, rounds: int = 200, tol: float = 1e-8) -> np.ndarray:
    """Minimum of f by a simplex of reflections, expansions, contractions and shrinks."""
    n = len(start)
    points = np.vstack([start, *(start + step * np.eye(n)[i] for i in range(n))])
    values = np.array([f(p) for p in points])
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if values[-1] - values[0] < tol:
            break
        middle = points[:-1].mean(axis=0)
        far = middle + (middle - points[-1])
        at = f(far)
        if at < values[0]:
            further = middle + 2 * (middle - points[-1])
            v = f(further)
            points[-1], values[-1] = (further, v) if v < at else (far, at)
        elif at < values[-2]:
            points[-1], values[-1] = far, at
        else:
            near = middle + 0.5 * ((far if at < values[-1] else points[-1]) - middle)
            v = f(near)
            if v < min(at, values[-1]):
                points[-1], values[-1] = near, v
            else:
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = [f(p) for p in points[1:]]
    return points[values.argmin()]


def garch_variances(steps: np.ndarray, horizon: int) -> np.ndarray | None:
    """Variances of the next steps under a zero-mean GARCH(1, 1); None for short or flat series."""
    x = 100 * np.asarray(steps, float)
    if len(x) < 20 or not np.isfinite(x).all() or x.var() <= 0:
        return None
    base = x.var()

    def parts(theta):
        a, b = 1 / (1 + np.exp(-np.clip(theta[:2], -30, 30)))
        return base * np.exp(theta[2]) * 0.05, a * 0.999, b * (1 - a * 0.999) * 0.999

    def path(theta):
        w, a, b = parts(theta)
        h = np.empty(len(x) + 1)
        h[0] = base
        for t in range(len(x)):
            h[t + 1] = w + a * x[t] ** 2 + b * h[t]
        return h

    def loss(theta):
        h = np.maximum(path(theta)[:-1], 1e-8)
        return float((np.log(h) + x**2 / h).mean())

    best = nelder_mead(loss, np.array([-2.0, 1.5, 0.0]))
    w, a, b = parts(best)
    out = [path(best)[-1]]
    for _ in range(horizon - 1):
        out.append(w + (a + b) * out[-1])
    return np.array(out) / 1e4


def garch(series: DataFrame, key: str, order: str, step: str, horizon: int = 7) -> DataFrame:
    """key, n, vol1 and vol_h (root mean variance over the horizon), null where the fit has none."""
    kind = series.schema[key].dataType.simpleString()

    def run(name: tuple, part: pd.DataFrame) -> pd.DataFrame:
        steps = part.sort_values(order)[step].dropna().to_numpy()
        v = garch_variances(steps, horizon)
        found = (None, None) if v is None else (float(np.sqrt(v[0])), float(np.sqrt(v.mean())))
        return pd.DataFrame({key: [name[0]], "n": [len(steps)], "vol1": [found[0]], "vol_h": [found[1]]})

    return series.groupBy(key).applyInPandas(run, f"`{key}` {kind}, n long, vol1 double, vol_h double")


def project_l1(a: np.ndarray, budget: float) -> np.ndarray:
    """Nearest point with sum of absolute values at most ``budget``."""
    if np.abs(a).sum() <= budget:
        return a
    u = np.sort(np.abs(a))[::-1]
    run = np.cumsum(u) - budget
    at = np.flatnonzero(u * np.arange(1, len(u) + 1) > run)[-1]
    return np.sign(a) * np.maximum(np.abs(a) - run[at] / (at + 1), 0)


def log_growth(a: np.ndarray, q: np.ndarray, price: np.ndarray, wealth: float, cost: np.ndarray, held: np.ndarray) -> float:
    """Expected log growth of signed stakes (YES > 0, NO < 0) if exactly one name wins."""
    yes, no = np.maximum(a, 0), np.maximum(-a, 0)
    shares_yes, shares_no = yes / (price * (1 + cost)), no / ((1 - price) * (1 + cost))
    after = wealth - np.abs(a).sum() - (cost * np.abs(a - held)).sum() + shares_yes + shares_no.sum() - shares_no
    if (after[q > 0] <= 0).any():
        return -1e6
    return float((q * np.log(np.maximum(after, 1e-12) / wealth)).sum())


#: Terms of the series of a sum of logarithms, and how far from the least wealth it is used: the rest is below rounding.
TERMS, NEAR = 8, 0.02


def growth_gradient(a: np.ndarray, q: np.ndarray, price: np.ndarray, wealth: float, cost: np.ndarray, held: np.ndarray, h: float) -> np.ndarray:
    """Central differences of ``log_growth`` by each stake, all names at once.

    A moved name shifts the wealth under every winner by one amount, and under its own by one
    more. The sum of logarithms over winners is a power series of that amount, whose sums are
    the same for all names. Names whose shift is not small are summed winner by winner.
    """
    yes, no = price * (1 + cost), (1 - price) * (1 + cost)
    base = wealth - np.abs(a).sum() - (cost * np.abs(a - held)).sum() + np.maximum(a, 0) / yes + (np.maximum(-a, 0) / no).sum() - np.maximum(-a, 0) / no
    live = q > 0
    least = base[live].min(initial=np.inf)

    def shifts(step):
        """Of each moved name: the shift under all winners, and what its own has besides."""
        new = a + step
        up, down = np.maximum(new, 0) / yes - np.maximum(a, 0) / yes, np.maximum(-new, 0) / no - np.maximum(-a, 0) / no
        return np.abs(a) - np.abs(new) + cost * (np.abs(a - held) - np.abs(new - held)) + down, up - down

    (up, own_up), (down, own_down) = shifts(h), shifts(-h)
    far = np.ones(len(a), bool)
    if least > 0:
        far = (np.maximum(np.abs(up), np.abs(down)) > NEAR * least) | (live & (np.maximum(np.abs(own_up), np.abs(own_down)) > base / 2))

    out = np.zeros(len(a))
    near = ~far
    if near.any():
        u, power, terms = least / base[live], q[live], []
        for k in range(1, TERMS + 1):
            power = power * u
            terms.append((-1) ** (k + 1) * power.sum() / k)
        total = np.zeros((2, int(near.sum())))
        x = np.stack([up[near], down[near]]) / least
        for term in reversed(terms):
            total = (total + term) * x
        own = np.where(live, base, 1.0)[near]
        out[near] = total[0] - total[1] + q[near] * np.where(live[near], np.log1p(own_up[near] / (own + up[near])) - np.log1p(own_down[near] / (own + down[near])), 0.0)

    def values(rows, shift, own):
        after = base[None, :] + shift[rows, None]  # one row a moved name, one column a winner
        after[np.arange(len(rows)), rows] += own[rows]
        ruined = (after[:, live] <= 0).any(axis=1)
        return np.where(ruined, -1e6, (q * np.log(np.maximum(after, 1e-12) / wealth)).sum(axis=1))

    every = np.flatnonzero(far)
    for i in range(0, len(every), 256):
        rows = every[i : i + 256]
        out[rows] = values(rows, up, own_up) - values(rows, down, own_down)
    return out / (2 * h)


def kelly_solve(q: np.ndarray, price: np.ndarray, wealth: float, budget: float, cost: np.ndarray, held: np.ndarray, free: np.ndarray, seed: int = 0, rounds: int = 120) -> np.ndarray:
    """Signed stakes of highest log growth within the budget; names that are not free stay 0.

    Projected ascent with a numeric gradient from three starts: what is held, nothing, and a
    seeded random point. The toll on changes makes a kink at ``held``, which is why it starts there.
    """
    rng = np.random.default_rng(seed)

    def value(a):
        return log_growth(a, q, price, wealth, cost, held)

    best, best_v = np.zeros(len(q)), value(np.zeros(len(q)))
    for start in (np.where(free, held, 0.0), np.zeros(len(q)), np.where(free, rng.normal(0, budget / (4 * len(q)), len(q)), 0.0)):
        a = project_l1(start, budget)
        v, step = value(a), budget / 4
        for _ in range(rounds):
            h = max(1e-4 * budget, 1e-6)
            grad = np.where(free, growth_gradient(a, q, price, wealth, cost, held, h), 0.0)
            norm = np.abs(grad).max()
            if norm <= 0 or step < 1e-4 * budget:
                break
            new = project_l1(a + step * grad / norm, budget)
            after = value(new)
            if after > v + 1e-12:
                a, v = new, after
            else:
                step /= 2
        if v > best_v:
            best, best_v = a, v
    return best


def backtest(days: DataFrame, *, book: str, day: str, name: str, price: str, prob: str, snapshot: str, won: str, wealth: float = 1000.0, spread: float = 0.02, rounds: int = 120) -> DataFrame:
    """The daily fold of each book: book, day, equity, n_open, traded, and a settled last row.

    Days follow each other, so a book is one task: targets from the portfolio solve on
    all names of the day, then the no-trade region over these and what is held (held names
    without a price that day have target 0 and trade at their last price), then marks.
    """
    kinds = {f.name: f.dataType.simpleString() for f in days.schema.fields}
    schema = f"`{book}` {kinds[book]}, `{day}` {kinds[day]}, equity double, n_open long, traded double, settled boolean"

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        cash, shares, fairs, region, marks = wealth, {}, {}, Region(), []
        part = part.sort_values([day, name], kind="stable")
        last: dict = {}
        winners = set(part.loc[part[won] == 1, name])
        for when, today in part.groupby(day, sort=True):
            last.update(zip(today[name], today[price], strict=True))
            seen = today[snapshot].iloc[0]
            solved = today[name].tolist()
            ids = solved + sorted(set(shares) - set(solved))
            px = np.clip(np.array([last[i] for i in ids], float), 0.01, 0.99)
            q = today[prob].to_numpy(float)
            q = q / q.sum() if q.sum() > 0 else np.full(len(q), 1 / len(q))
            n = len(solved)
            held = np.array([shares.get(i, 0.0) * (p if shares.get(i, 0.0) > 0 else 1 - p) for i, p in zip(ids, px, strict=True)])
            equity = cash + sum(s * last[i] if s > 0 else -s * (1 - last[i]) for i, s in shares.items())
            target = kelly_solve(q, px[:n], max(equity, 1.0), max(equity, 1.0) * 0.5, np.full(n, spread), held[:n], np.ones(n, bool), seed_of(key[0], when), rounds=rounds)
            target = np.concatenate([target, np.zeros(len(ids) - n)])
            fairs.update(zip(solved, q.tolist(), strict=True))
            fair = np.array([fairs[i] for i in ids])  # the last one known of a name without a price
            stakes = region.step(ids, target, held, fair, px, lambda size: np.full(len(size), spread), equity, seen)
            traded = 0.0
            for i, p, new, h in zip(ids, px, stakes.tolist(), held.tolist(), strict=True):
                if abs(new - h) < MIN_TICKET:
                    continue
                if h and np.sign(new) != np.sign(h):  # close the other side first
                    cash += abs(h) * (1 - spread)
                    traded += abs(h)
                    shares.pop(i)
                    h = 0.0
                move = abs(new) - abs(h)
                leg = p if new > 0 else 1 - p
                cash -= move * (1 + spread) if move > 0 else move * (1 - spread)
                now = shares.get(i, 0.0) + np.sign(new or h) * move / leg
                traded += abs(move)
                if abs(now) < 1e-9 or abs(new) < 1e-9:
                    shares.pop(i, None)
                else:
                    shares[i] = now
            equity = cash + sum(s * last[i] if s > 0 else -s * (1 - last[i]) for i, s in shares.items())
            marks.append((key[0], when, float(equity), len(shares), float(traded), False))
        settled = cash + sum((s if i in winners else 0.0) if s > 0 else (0.0 if i in winners else -s) for i, s in shares.items())
        marks.append((key[0], marks[-1][1], float(settled), 0, 0.0, True))
        return pd.DataFrame(marks, columns=[book, day, "equity", "n_open", "traded", "settled"])

    return days.groupBy(book).applyInPandas(run, schema)


#: Horizons of the corpus of moves, kernel bandwidths, effective rows that need no model.
MOVE_HORIZONS = (7, 14, 30)
BANDWIDTHS, LEAST_EFFECTIVE = (0.12, 0.7), 15.0
#: Steps of season fraction, logit and move in which the corpus is counted.
CORPUS_STEPS = (0.05, 0.1, 0.05)


def move_corpus(moves: DataFrame) -> dict[int, np.ndarray]:
    """Counted moves (h, frac, z, net) by horizon: rows of frac, z, net, count.

    Moves are counted in steps, so the table is bounded by the ranges of its columns, however
    many moves there are; it is what every worker needs.
    """
    steps = dict(zip(("frac", "z", "net"), CORPUS_STEPS, strict=True))
    binned = moves.filter("net is not null").groupBy("h", *[F.round(F.col(c) / s).cast("int").alias(c) for c, s in steps.items()]).agg(F.count(F.lit(1)).alias("n"))
    rows = np.array([tuple(r) for r in binned.orderBy("h", *steps).collect()], float).reshape(-1, 5)
    return {h: rows[rows[:, 0] == h, 1:] * [*CORPUS_STEPS, 1] for h in MOVE_HORIZONS}


def sample_moves(corpus: dict[int, np.ndarray], steps: int, price: float, frac: float, vol: float, draws: int, rng: np.random.Generator) -> np.ndarray:
    """Signed log-odds moves of so many steps, drawn around (frac, price).

    Past moves of the nearest horizon are drawn by kernel weight, with a jitter of 0.15 of
    their spread. Where few rows stand behind the weights, a share of the draws comes from the
    volatility instead; all of them where there are hardly any.
    """
    table = corpus[min(MOVE_HORIZONS, key=lambda h: (abs(h - steps), h))]
    scale = vol * np.sqrt(max(steps, 1))
    if table[:, 3].sum() < 5:
        return rng.normal(0.0, scale, draws)
    z = np.log(price / (1 - price))
    kernel = np.exp(-0.5 * (((table[:, 0] - frac) / BANDWIDTHS[0]) ** 2 + ((table[:, 1] - z) / BANDWIDTHS[1]) ** 2))
    w = kernel * table[:, 3]
    if w.sum() <= 0:
        return rng.normal(0.0, scale, draws)
    effective = w.sum() ** 2 / max((kernel * w).sum(), 1e-300)
    own = int(round(min(1.0, effective / LEAST_EFFECTIVE) * draws))
    mean = np.average(table[:, 2], weights=w)
    spread = np.sqrt(max(np.average((table[:, 2] - mean) ** 2, weights=w), 1e-9))
    found = table[rng.choice(len(table), own, p=w / w.sum()), 2] + rng.normal(0, 0.15 * spread, own)
    moves = np.concatenate([found, rng.normal(0.0, scale, draws - own)])
    rng.shuffle(moves)
    return moves


def forward_edge(rows: DataFrame, corpus: dict[int, np.ndarray], *, key: str, price: str, frac: str, vol: str, cost: float = 0.02, horizon: int = 14, draws: int = 2000, seed: int = 9) -> DataFrame:
    """key, edge_mean, cvar, radj, dispersion of a survival-weighted mixture of k-step moves.

    Moves of 1 to ``horizon`` steps are drawn from the corpus, as many of each as its survival
    weight, and less their mean. Rows are independent, so they go through in Arrow batches.
    """
    kind = rows.schema[key].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(corpus)

    def run(parts):
        for part in parts:
            out = []
            for name, p, f, sd in zip(part[key], part[price], part[frac], part[vol], strict=True):
                rng = np.random.default_rng(seed_of(seed, name))
                p = min(max(p, 1e-4), 1 - 1e-4)
                life = 17 - 8 * min(max(f, 0), 1)
                w = 0.5 ** (np.arange(horizon) / life)
                counts = np.maximum(1, np.round(w / w.sum() * draws).astype(int))
                moved = np.concatenate([sample_moves(shared.value, k, p, f, sd, n, rng) for k, n in enumerate(counts.tolist(), 1)])
                moved -= moved.mean()
                future = np.clip(1 / (1 + np.exp(-(np.log(p / (1 - p)) + moved))), 1e-4, 1 - 1e-4)
                edge = future - p - cost
                low = edge[edge <= np.quantile(edge, 0.05)]
                cvar = max(1e-6, -low.mean())
                out.append((name, edge.mean(), cvar, float(np.clip(edge.mean() / max(cvar, 0.05), -10, 10)), future.std()))
            yield pd.DataFrame(out, columns=[key, "edge_mean", "cvar", "radj", "dispersion"])

    return rows.select(key, price, frac, vol).mapInPandas(run, f"`{key}` {kind}, edge_mean double, cvar double, radj double, dispersion double")
