"""Curves of whole cities predicted from cities alike, without their components, NumPy only.

Each method chooses its one setting by leaving out every training city in turn and comparing whole curves."""

from __future__ import annotations

import numpy as np

from odresil.kernels import solve

#: Penalties of the parameter ridge and widths of the mixture (fixed values).
PENALTIES, WIDTHS = tuple(np.logspace(-2, 3, 11)), (0.35, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0)


def percent_error(guess: np.ndarray, truth: np.ndarray) -> float:
    """Mean absolute percentage error over the days that have both; infinite without one."""
    ok = np.isfinite(guess) & np.isfinite(truth) & (np.abs(truth) > 1e-8)
    return float(100 * np.mean(np.abs(guess[ok] / truth[ok] - 1))) if ok.any() else np.inf


def scores(train: np.ndarray, test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sides as standard scores of the training side."""
    centre, size = train.mean(0), train.std(0)
    size = np.where(size > 0, size, 1.0)
    return (train - centre) / size, (test - centre) / size


def from_parameters(days: np.ndarray, start: float, parameters: np.ndarray) -> np.ndarray:
    """The curve of a rate, a level and a pulse, each within the bounds of the fits; ones without a usable start."""
    if not np.isfinite(start) or start <= 1e-6:
        return np.ones(len(days))
    return solve.curve(days, start, *np.clip(parameters, solve.LOW, solve.HIGH))


def ridge(x: np.ndarray, y: np.ndarray, new: np.ndarray, penalty: float) -> np.ndarray:
    """Several outputs at once, each standardised, predicted for a new row by ridge on standardised inputs."""
    z, zn = scores(x, new)
    t, _ = scores(y, y)
    size = np.where(y.std(0) > 0, y.std(0), 1.0)
    beta = np.linalg.solve(z.T @ z + penalty * np.eye(z.shape[1]), z.T @ t)
    return zn @ beta * size + y.mean(0)


def mixture(x: np.ndarray, curves: np.ndarray, new: np.ndarray, width: float) -> np.ndarray:
    """Training curves weighted by a Gaussian of the distance in standard scores; all alike where no weight is left."""
    z, zn = scores(x, new)
    weight = np.exp(-0.5 * np.mean((z - zn) ** 2, axis=1) / width**2)
    weight = weight / weight.sum() if weight.sum() > 0 else np.full(len(z), 1 / len(z))
    return weight @ curves


def chosen(settings, predict, truth: np.ndarray) -> float:
    """The setting whose predictions of left-out training cities are nearest to their curves, the first of equals.

    predict: (indexes to learn from, index to predict, setting) to a curve."""
    every = np.arange(len(truth))
    error = [np.mean([percent_error(predict(every[every != k], k, s), truth[k]) for k in every]) for s in settings]
    return float(settings[int(np.argmin(error))])


def ridge_curve(days: np.ndarray, x: np.ndarray, parameters: np.ndarray, curves: np.ndarray, new: np.ndarray, start: float) -> tuple[np.ndarray, float]:
    """(curve, penalty) of a new city by ridge from features to the parameters of fitted curves."""
    guess = lambda rows, k, penalty: from_parameters(days, curves[k, 0], ridge(x[rows], parameters[rows], x[k], penalty))
    penalty = chosen(PENALTIES, guess, curves)
    return from_parameters(days, start, ridge(x, parameters, new, penalty)), penalty


def kernel_curve(x: np.ndarray, curves: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, float]:
    """(curve, width) of a new city as a mixture of the training cities' curves."""
    width = chosen(WIDTHS, lambda rows, k, w: mixture(x[rows], curves[rows], x[k], w), curves)
    return mixture(x, curves, new, width), width


def neighbours(train: np.ndarray, y: np.ndarray, test: np.ndarray) -> np.ndarray:
    """Means of ``y`` by clipped cosine in the training rows' standard scores; the plain mean where no row is near."""
    z, v = scores(train, test)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    w = np.clip(unit(v) @ unit(z).T, 0, None)
    total = w.sum(1)
    return np.where(total > 0, w @ y / np.where(total > 0, total, 1), y.mean())
