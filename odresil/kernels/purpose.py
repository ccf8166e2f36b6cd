"""How widely the losses of an unseen unit spread, from the purposes that its components serve.

A unit enters by moments alone: means of squares and products of its centred share products, of these with its centred
losses, and of the losses' squares.  Sets of units are boolean masks over stacked moments, so leaving a unit out, or one
inside the other, is a change of mask and a mean; no rows are put together again.  Every unit weighs the same."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np

from odresil.kernels import solve

#: Ridge penalties, what keeps a logarithm finite, least components and least units, budgets of the simplex (fixed values).
PENALTIES = np.logspace(-3, 3, 13)
TINY, LEAST_COMPONENTS, LEAST_UNITS, BUDGETS = 1e-12, 3, 4, (20_000, 100_000)


@dataclass
class Moments:
    """Stacked moments of units; ``known`` marks those whose losses are."""

    names: list
    known: np.ndarray
    rows: np.ndarray
    squares: np.ndarray
    cross: np.ndarray
    power: np.ndarray
    log_variance: np.ndarray
    losses: list[np.ndarray]

    def at(self, name) -> int | None:
        return self.names.index(name) if name in self.names else None


def moments(units: dict) -> Moments:
    """From {name: (shares [component, category], losses or None)}; units of too few components, or with a missing share, are
    left out."""
    names, parts = [], []
    for name, (shares, loss) in units.items():
        shares = np.asarray(shares, float)
        if len(shares) < LEAST_COMPONENTS or np.isnan(shares).any() or np.isinf(shares).any():
            continue
        known = loss is not None and bool(np.isfinite(loss).all())
        x = np.einsum("ca,cb->cab", shares, shares)[:, *np.triu_indices(shares.shape[1], 1)]
        x, y = x - x.mean(0), np.asarray(loss, float) - np.mean(loss) if known else np.zeros(len(shares))
        names.append(name)
        parts.append((known, len(x), x.T @ x / len(x), x.T @ y / len(x), y @ y / len(x), np.log(shares.var(0) + TINY), y))
    columns = list(zip(*parts)) or [()] * 7
    return Moments(names, np.array(columns[0], bool), np.array(columns[1], float), *(np.array(c) for c in columns[2:6]), list(columns[6]))


def rules(m: Moments, use: np.ndarray) -> np.ndarray:
    """Coefficients [penalty, product] of the masked units' losses, for each ridge penalty."""
    total, square, cross = m.rows[use].sum(), m.squares[use].mean(0), m.cross[use].mean(0)
    size = np.sqrt(np.diagonal(square))
    size = np.where(size < TINY, 1.0, size)
    values, axes = np.linalg.eigh(total * square / np.outer(size, size))
    loads = axes.T @ (total * cross / size)
    return (axes @ (loads[:, None] / (values[:, None] + PENALTIES))).T / size


def rule(m: Moments, use: np.ndarray) -> tuple[np.ndarray, float]:
    """The rule, and its penalty, that predicts the masked units best, each by the others."""
    error = np.zeros(len(PENALTIES))
    for k in np.flatnonzero(use):
        others = use.copy()
        others[k] = False
        beta = rules(m, others)
        error += np.einsum("pi,ij,pj->p", beta, m.squares[k], beta) - 2 * beta @ m.cross[k] + m.power[k]
    best = int(np.argmin(error))
    return rules(m, use)[best], float(PENALTIES[best])


def inputs(m: Moments, use: np.ndarray, held: int) -> np.ndarray:
    """[unit, seven]: log variances of the shares, and the deviation of a score by a rule that the unit's own losses did not
    shape; for the masked units and the held one, missing for all others."""
    if use[held]:
        raise ValueError("a held unit can't be one that is learned from")
    out = np.full((len(m.names), m.log_variance.shape[1] + 1), np.nan)
    for k in [*np.flatnonzero(use), held]:
        others = use.copy()
        others[k] = False
        beta = rule(m, others)[0]
        out[k] = [*m.log_variance[k], np.sqrt(max(beta @ m.squares[k] @ beta, 0.0))]
    return out


@dataclass
class Stretch:
    """What a unit's inputs and backbone do to the common spectrum."""

    effects: np.ndarray
    centre: np.ndarray
    width: np.ndarray
    level: float
    spectrum: np.ndarray

    def log_factor(self, values: np.ndarray) -> float:
        return float(self.effects @ ((values - self.centre) / self.width))

    def of(self, backbone: float, values: np.ndarray) -> np.ndarray:
        """The centred spectrum of a unit with this backbone deviation and these inputs."""
        unit = self.spectrum / self.spectrum.std()
        out = unit * np.exp(self.level + np.log(backbone) + self.log_factor(values))
        return out - out.mean()


def _cost(effects, z, base, sizes, y, width: float, penalty: float) -> float:
    """Minus the log likelihood of all losses, each unit's divided by its scale, under the kernel density of them all."""
    with np.errstate(all="ignore"):
        log_scale = np.repeat(base + z @ effects, sizes)
        e = y * np.exp(-log_scale)
        near = np.exp(-0.5 * np.square((e[:, None] - e / e.std()) / width)).mean(1) / (width * np.sqrt(2 * np.pi))
        cost = log_scale.sum() - np.log(np.clip(near, 1e-300, None)).sum() + penalty * (effects @ effects)
    return float(cost) if np.isfinite(cost) else 1e100


def stretch(m: Moments, use: np.ndarray, values: np.ndarray, backbone: np.ndarray, grid: np.ndarray, width: float, penalty: float) -> Stretch:
    """Effects of the standardised inputs that make the masked units' losses likeliest; none where none are better."""
    at = np.flatnonzero(use)
    centre, spread = values[at].mean(0), values[at].std(0)
    spread = np.where(spread > 0, spread, 1.0)
    spectrum = np.mean([np.quantile(m.losses[k], grid) for k in at], axis=0)
    spectrum = spectrum - spectrum.mean()
    level = float(np.log(spectrum.std()) - np.log(backbone[at].mean()))
    data = (values[at] - centre) / spread, level + np.log(backbone[at]), [len(m.losses[k]) for k in at], np.concatenate([m.losses[k] for k in at])
    none = np.zeros(values.shape[1])
    best = none
    for budget in BUDGETS:
        best, cost, settled = solve.nelder_mead_checked(lambda e: _cost(e, *data, width, penalty), best, budget)
        if settled:
            break
    else:
        raise RuntimeError(f"no optimum of the spread within {BUDGETS[-1]} steps")
    return Stretch(best if cost <= _cost(none, *data, width, penalty) else none, centre, spread, level, spectrum)


def multiplier(held, units: dict, backbone: dict, grid: np.ndarray, widths, penalties) -> tuple[float, dict]:
    """The factor on the held unit's backbone ratio, and how it came about; 1 where too few units can be learned from.

    Kernel width and penalty are those whose spectra come nearest to the true ones of the units learned from, each predicted
    without its own losses; the first of equally good ones."""
    m = moments(units)
    deviation = np.array([backbone.get(n, np.nan) for n in m.names], float)
    here = m.at(held)
    use = m.known & np.isfinite(deviation) & (deviation > 0) & np.array([n != held for n in m.names], bool)
    if here is None or use.sum() < LEAST_UNITS:
        return 1.0, {"fallback": f"fewer than {LEAST_UNITS} units to learn from"}
    trials = {}
    for k in np.flatnonzero(use):
        rest = use.copy()
        rest[k] = False
        values, truth = inputs(m, rest, k), np.quantile(m.losses[k], grid)
        for width, penalty in product(widths, penalties):
            guess = stretch(m, rest, values, deviation, grid, width, penalty).of(deviation[k], values[k])
            trials.setdefault((width, penalty), []).append(np.abs(guess - truth).mean())
    (width, penalty), far = min(trials.items(), key=lambda t: np.mean(t[1]))
    values = inputs(m, use, here)
    found = stretch(m, use, values, deviation, grid, width, penalty)
    return float(np.exp(found.log_factor(values[here]))), {"distance": float(np.mean(far)), "width": width, "penalty": penalty, "effects": found.effects.tolist()}
