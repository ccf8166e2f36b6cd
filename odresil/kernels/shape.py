"""The shape of an unseen unit's losses: a reference distribution moved along two modes, kept monotone.

Distributions are step functions on [0, 1], a step for each sorted value.  One matrix of overlaps between a distribution's
steps and the cells of a common partition takes it to that partition, and its inner products with modes along with it,
whether or not the partition refines the steps."""

from __future__ import annotations

import numpy as np

from odresil.kernels import backbone, solve

#: Penalties of an amplitude, the last leaving the reference as it is; least units; what counts as no spread (fixed values).
PENALTIES = (0.1, 1.0, 10.0, 100.0, 1000.0, np.inf)
LEAST_UNITS, TINY, MODES = 4, 1e-12, 2


class NoShape(ValueError):
    """The shape can't be predicted; the text says why."""


def partition(sizes) -> np.ndarray:
    """Edges of the cells on which all step functions of these sizes are constant."""
    return np.unique(np.round(np.concatenate([np.linspace(0, 1, n + 1) for n in sizes]), 12))


def overlaps(n: int, edges: np.ndarray) -> np.ndarray:
    """[step, cell]: how much of each of n equal steps lies in each cell."""
    low, high = np.arange(n)[:, None] / n, np.arange(1, n + 1)[:, None] / n
    return np.clip(np.minimum(high, edges[1:]) - np.maximum(low, edges[:-1]), 0, None)


def standard(values: np.ndarray) -> np.ndarray:
    """Sorted standard scores."""
    size = values.std()
    if not size >= TINY:
        raise NoShape("a distribution without spread")
    return np.sort(values - values.mean()) / size


class Space:
    """The distributions of the units that are learned from, on a partition: reference, mean and leading modes."""

    def __init__(self, losses: dict, names: list, edges: np.ndarray):
        self.edges, self.weight = edges, np.diff(edges)
        self.rows = np.array([self.on_cells(standard(losses[n])) for n in names])
        self.mean = self.rows.mean(0)
        root = np.sqrt(self.weight)
        axes = np.linalg.svd((self.rows - self.mean) * root, full_matrices=False)[2][:MODES]
        if len(axes) < MODES:
            raise NoShape("fewer than two modes")
        axes = axes / root
        self.modes = np.array([a * np.copysign(1.0, a[np.argmax(np.abs(a))]) for a in axes])
        raw = np.mean([self.on_cells(np.sort(losses[n]) - losses[n].mean()) for n in names], axis=0)
        self.size = float(np.sqrt(self.weight @ raw**2))
        if not self.size >= TINY:
            raise NoShape("a reference without spread")
        self.reference = raw / self.size

    def on_cells(self, steps: np.ndarray) -> np.ndarray:
        return steps @ overlaps(len(steps), self.edges) / self.weight

    def amplitudes(self, row: np.ndarray) -> np.ndarray:
        """How far a distribution on the cells lies from the reference along each mode."""
        return self.modes @ (self.weight * (row - self.reference))

    def implied(self, values: np.ndarray) -> np.ndarray:
        """How far a distribution of any size lies from the mean along each mode."""
        steps = standard(values)
        return self.modes @ (steps @ overlaps(len(steps), self.edges) - self.weight * self.mean)


def guesses(losses: dict, start: dict, alpha_of, days, train: list, held, edges: np.ndarray) -> tuple[Space, np.ndarray]:
    """The training units' space, and the held unit's amplitudes [penalty, mode] by ridge on what its backbone implies.

    Each unit's backbone has the rate of the training units but itself."""
    space, seen = Space(losses, train, edges), []
    for name in [*train, held]:
        others = [n for n in train if n != name]
        flow = backbone.losses(start[name], alpha_of(others), days) if len(others) >= 2 else np.empty(0)
        if flow.size < 2:
            raise NoShape("too little to imply a backbone from")
        seen.append(space.implied(flow))
    seen, goal = np.array(seen), np.array([space.amplitudes(r) for r in space.rows])
    centre, size = seen[:-1].mean(0), seen[:-1].std(0)
    z = (seen - centre) / np.where(size < TINY, 1.0, size)
    square, cross = z[:-1].T @ z[:-1], z[:-1].T @ (goal - goal.mean(0))
    out = [goal.mean(0) + z[-1] @ np.linalg.solve(square + p * np.eye(MODES), cross) if np.isfinite(p) else np.zeros(MODES) for p in PENALTIES]
    return space, np.array(out)


def predicted(losses: dict, start: dict, alpha_of, days, held, score: np.ndarray) -> np.ndarray:
    """The held unit's centred losses in the order of its components; raises ``NoShape`` where they can't be predicted.

    Each mode has a penalty of its own, the one that serves the training units best, each left out in turn.  Of the held unit
    only first values, scores and the number of components are used."""
    train = [n for n, v in losses.items() if n != held and len(v) >= 2]
    if len(train) < LEAST_UNITS:
        raise NoShape(f"fewer than {LEAST_UNITS} units to learn from")
    edges = partition([*(len(losses[n]) for n in train), len(score)])
    try:
        space, mine = guesses(losses, start, alpha_of, days, train, held, edges)
        error = np.zeros(mine.shape)
        for name in train:
            inner, theirs = guesses(losses, start, alpha_of, days, [n for n in train if n != name], name, edges)
            error += np.square(theirs - inner.amplitudes(inner.on_cells(standard(losses[name]))))
    except np.linalg.LinAlgError as problem:
        raise NoShape("singular moments") from problem
    amplitude = np.take_along_axis(mine, error.argmin(0)[None], 0)[0]
    curve = solve.monotone(space.reference + amplitude @ space.modes, space.weight)
    curve = curve - space.weight @ curve
    size = float(np.sqrt(space.weight @ curve**2))
    if not size >= TINY:
        raise NoShape("a prediction without spread")
    return space.size / size * curve[cells(score, edges)]


def cells(score: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The cell in which the middle of each score's step lies; equal scores follow in their order."""
    order = np.lexsort((np.arange(len(score)), score))
    place = np.empty(len(score))
    place[order] = (np.arange(len(score)) + 0.5) / len(score)
    return np.clip(np.searchsorted(edges, place) - 1, 0, len(edges) - 2)
