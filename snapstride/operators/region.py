"""The no-trade region: what to hold of each name, given a target for it and what is held."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Sequence

import numpy as np

#: How much wider the band is for a trim after the fair value rose, stood or fell, and what counts as standing.
TRIM_WIDTHS, DRIFT = (3.0, 2.0, 1.0), 0.01
FLAT = 1e-9


class Region:
    """One book's region, with what it remembers of each name between steps.

    Stakes are signed dollars, below 0 on the NO leg. A flat name opens at its target. A held
    one stays inside a band around the target, round-trip cost over the curvature of growth,
    and else goes to the band's edge; trims have wider bands while the fair value moves the
    position's way. A target on the other side has to come in ``confirm`` fresh snapshots in a
    row, then it is traded in full.
    """

    def __init__(self, hysteresis: float = 1.0, confirm: int = 2, margin: float = 1.0, hurdle: float = 0.05, least_fill: float = 0.05, fill_rate: float = 3.2, least_trade: float = 0.0, trims: tuple[float, float, float] = TRIM_WIDTHS):
        self.hysteresis, self.confirm, self.margin, self.hurdle = hysteresis, confirm, margin, hurdle
        self.least_fill, self.fill_rate, self.least_trade, self.trims = least_fill, fill_rate, least_trade, trims
        self.streak: dict[Hashable, int] = {}
        self.seen: dict[Hashable, Hashable] = {}
        self.fair: dict[Hashable, float] = {}
        self.drift: dict[Hashable, float] = {}

    def wanted(self, target: np.ndarray, held: np.ndarray, sigma: np.ndarray | None, radj: np.ndarray | None) -> np.ndarray:
        """Targets after the fill; names that are flat open only above the hurdle."""
        if sigma is not None:
            fill = np.clip(1 / (1 + self.fill_rate * sigma), 0, 1)
            target = np.where(fill < self.least_fill, 0.0, target * fill)
        return target if radj is None else np.where((np.abs(held) < FLAT) & (radj <= self.hurdle), 0.0, target)

    def band(self, wanted: np.ndarray, held: np.ndarray, fair: np.ndarray, price: np.ndarray, one_way: Callable[[np.ndarray], np.ndarray], budget: float) -> np.ndarray:
        """Half-width in dollars: round-trip cost at the larger size, over the curvature at the target."""
        yes = self._side(wanted, held) > 0
        px = np.clip(price, 1e-4, 1 - 1e-4)
        p, b = np.where(yes, fair, 1 - fair), np.where(yes, (1 - px) / px, px / (1 - px))
        f = np.clip(np.abs(wanted) / budget, 0, 0.999)
        curve = p * b**2 / (1 + b * f) ** 2 + (1 - p) / (1 - f) ** 2
        cost = 2 * one_way(np.maximum(np.maximum(np.abs(held), np.abs(wanted)), 1.0))
        return self.hysteresis * cost / np.maximum(curve, 1e-12) * budget

    @staticmethod
    def _side(wanted: np.ndarray, held: np.ndarray) -> np.ndarray:
        side = np.where(np.abs(wanted) > FLAT, np.sign(wanted), np.sign(held) * (np.abs(held) >= FLAT))
        return np.where(side == 0, 1.0, side)

    def _moved(self, names: Sequence, fair: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """How far each fair value moved between the last two snapshots."""
        for name, value, new in zip(names, fair.tolist(), fresh.tolist(), strict=True):
            if new:
                self.drift[name] = value - self.fair.get(name, value)
                self.fair[name] = value
        return np.array([self.drift.get(n, 0.0) for n in names])

    def step(self, names: Sequence, target, held, fair, price, one_way: Callable[[np.ndarray], np.ndarray], budget: float, snapshot: Hashable, *, sigma=None, radj=None, out=None) -> np.ndarray:
        """New stakes of the names; ``out`` marks those to be closed whatever the band says."""
        target, held, fair, price = (np.asarray(x, float) for x in (target, held, fair, price))
        out = np.zeros(len(held), bool) if out is None else np.asarray(out, bool)
        budget, flat = max(float(budget), 1.0), np.abs(held) < FLAT
        wanted = self.wanted(target, held, sigma, radj)
        fresh = np.array([self.seen.get(n) != snapshot for n in names], bool)
        self.seen.update((n, snapshot) for n in names)

        width = self.band(wanted, held, fair, price, one_way, budget)
        move = self._moved(names, fair, fresh) * self._side(wanted, held)
        trim = ~flat & (np.abs(wanted) < np.abs(held)) & ((np.sign(wanted) == np.sign(held)) | (np.abs(wanted) <= FLAT))
        up, still, down = self.trims
        width = width * np.where(trim, np.where(move >= DRIFT, up, np.where(move > -DRIFT, still, down)), 1.0)

        gap = held - wanted
        new = np.where(np.abs(gap) <= width, held, wanted + np.sign(gap) * width)
        new = np.where(flat, wanted, new)
        turns = ~out & ~flat & (np.sign(wanted) == -np.sign(held)) & (np.abs(wanted) > self.margin)
        streak = np.array([self.streak.get(n, 0) for n in names])
        streak = np.where(out, 0, np.where(turns, streak + fresh, np.where(fresh, 0, streak)))
        waits = turns & (streak < self.confirm)
        turned = turns & ~waits
        self.streak.update(zip(names, np.where(turned, 0, streak).tolist(), strict=True))
        new = np.where(out, 0.0, np.where(waits, held, np.where(turned, wanted, new)))
        least = self.least_trade * np.abs(held)
        return np.where(~out & ~turned & (np.abs(new - held) > 0) & (np.abs(new - held) < least), held, new)
