"""Component losses moved together until the curves that they stand for lose what the whole city does."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Distances from no shift that are looked at in turn, points of the fallback grid, parts of a bracket (fixed values).
RUNGS, POINTS, PARTS = tuple(2.0**k for k in range(9)), 65, 8


@dataclass
class City:
    """What makes component curves the city's: baselines [day, component], loadings [component], own baselines [day]."""

    base: np.ndarray
    loading: np.ndarray
    own: np.ndarray

    def __post_init__(self):
        self.base, self.loading, self.own = (np.asarray(v, float) for v in (self.base, self.loading, self.own))
        if self.base.shape != (*self.own.shape, *self.loading.shape):
            raise ValueError("a city needs a baseline for each of its days and components")
        for name, values, least in (("baselines", self.base, 0), ("loadings", self.loading, 0), ("own baselines", self.own, np.nextafter(0, 1))):
            if not (np.isfinite(values) & (values >= least)).all():
                raise ValueError(f"a city's {name} must be numbers of the right sign")

    def loss(self, curves: np.ndarray) -> float:
        curves = np.asarray(curves, float)
        if curves.shape != self.base.shape or not np.isfinite(curves).all():
            raise ValueError("curves must be numbers, one for each day and component")
        return float(np.sum(1 - (curves * self.base) @ self.loading / self.own))


@dataclass
class Shift:
    """A common shift, the gap between the city's loss and the wanted one, and the curves under it."""

    by: float
    gap: float
    curves: np.ndarray


def nearest_shift(losses: np.ndarray, wanted: float, city: City, decode: Callable[[np.ndarray], np.ndarray], tolerance: float = 1e-5) -> tuple[Shift, Shift]:
    """(the unshifted losses, the shift of least gap found); the second is no worse than the first, and is it where that fits.

    Rungs at growing distances on both sides are looked at until the gap changes its sign between one and the last on its
    side; the bracket is then narrowed.  Without a change, the best point of a grid over all rungs is taken and the grid
    made finer around it."""
    losses = np.array(losses, float)
    if losses.shape != city.loading.shape or not np.isfinite(losses).all() or not np.isfinite(wanted) or not tolerance > 0:
        raise ValueError("a shift needs a finite loss for each component, a finite total and a positive tolerance")

    def at(by: float) -> Shift:
        curves = decode(losses + by)
        return Shift(float(by), city.loss(curves) - wanted, np.asarray(curves, float))

    best = lambda shifts: min(shifts, key=lambda s: abs(s.gap))
    still = at(0.0)
    if abs(still.gap) <= tolerance:
        return still, still
    ends, found = {-1: still, 1: still}, None
    for rung in RUNGS:
        for side in ends:
            new = at(side * rung)
            if found is None and (new.gap > 0) != (ends[side].gap > 0):
                found = ends[side], new
            ends[side] = new
        if found:
            break
    if found:
        return still, best([still, *ends.values(), _narrowed(at, *found)])
    low, high, top = -RUNGS[-1], RUNGS[-1], still
    for points in (POINTS, *[PARTS + 1] * 20):
        shifts = [at(by) for by in np.linspace(low, high, points)]
        top, step = best([top, *shifts]), (high - low) / (points - 1)
        low, high = max(top.by - step, -RUNGS[-1]), min(top.by + step, RUNGS[-1])
    return still, top


def _narrowed(at, a: Shift, b: Shift) -> Shift:
    """The end of least gap after narrowing a bracket to an ``PARTS``-th some times."""
    for _ in range(20):
        inside = [a, *(at(by) for by in np.linspace(a.by, b.by, PARTS + 1)[1:-1]), b]
        a, b = next((x, y) for x, y in zip(inside, inside[1:]) if (x.gap > 0) != (y.gap > 0))
    return min((a, b), key=lambda s: abs(s.gap))
