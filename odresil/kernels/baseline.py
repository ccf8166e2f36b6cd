"""An additive baseline of a slotted series: piecewise linear trend, daily and weekly waves, and an 80 % interval.

It stands in for a Bayesian structural model: a ridge fit of the same terms, whose interval is that of its residuals."""

from __future__ import annotations

import numpy as np

#: Half-width of an 80 % interval in standard deviations; waves a day and a week; penalty of trend changes and waves.
INTERVAL, DAILY, WEEKLY, PENALTY, KNOTS = 1.2816, 4, 3, 1e-3, 5


def _terms(t: np.ndarray, length: int, slots: int) -> np.ndarray:
    knots = np.linspace(0, 0.8 * length, KNOTS + 2)[1:-1]
    columns = [np.ones(len(t)), t / length, *(np.maximum(t - k, 0) / length for k in knots)]
    for period, waves in ((slots, DAILY), (7 * slots, WEEKLY)):
        for k in range(1, waves + 1):
            columns += [np.sin(2 * np.pi * k * t / period), np.cos(2 * np.pi * k * t / period)]
    return np.stack(columns, 1)


def forecast(y: np.ndarray, ahead: int, slots: int) -> dict[str, np.ndarray]:
    """fit, trend and noise of the series, and forecast, lower and upper of the ``ahead`` slots after it."""
    n = len(y)
    x = _terms(np.arange(n, dtype=float), n, slots)
    penalty = np.full(x.shape[1], PENALTY * n)
    penalty[:2] = 0
    beta = np.linalg.lstsq(np.vstack([x, np.diag(np.sqrt(penalty))]), np.append(y, np.zeros(x.shape[1])), rcond=None)[0]
    fit = x @ beta
    wide = INTERVAL * float((y - fit).std())
    later = _terms(np.arange(n, n + ahead, dtype=float), n, slots) @ beta
    return {"fit": fit, "trend": x[:, : 2 + KNOTS] @ beta[: 2 + KNOTS], "noise": y - fit, "forecast": later, "lower": later - wide, "upper": later + wide}


def impact(series: np.ndarray, buffer: float = 0.0, method: str = "first_return", run: int = 3) -> dict | None:
    """last_normal, start, end and status of the first fall below -buffer; None without one."""
    below = np.flatnonzero(series < -buffer)
    if not len(below):
        return None
    start, last = int(below[0]), len(series) - 1
    end, status = last, "Fixed (End of Series)" if method == "end_of_series" else "Ongoing"
    up = series[start:] >= 0
    need = run if method == "consecutive" else 1
    if method != "end_of_series" and len(up) >= need:
        runs = np.flatnonzero(np.convolve(up, np.ones(need, int), "valid") == need)
        if len(runs):
            end, status = start + int(runs[0]), "Recovered"
    return {"last_normal": max(start - 1, 0), "start": start, "end": end, "status": status}


def trailing_mean(x: np.ndarray, n: int) -> np.ndarray:
    """Means of ``n`` values, missing until that many are there."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1 :] = np.convolve(x, np.ones(n) / n, "valid")
    return out


def decay(y: np.ndarray, back: int, slots: int, window: int, **how) -> tuple[np.ndarray, np.ndarray, dict | None]:
    """Relative change against the baseline of what lies before the last ``back`` slots, its smoothed form, and the impact.

    The impact is looked for in the smoothed change against the lower bound."""
    base = forecast(y[:-back], back, slots)
    actual = y[-back:]
    change = lambda to: np.divide(actual - to, to, out=np.full(back, np.nan), where=to != 0)
    pct, upper = trailing_mean(change(base["forecast"]), window), trailing_mean(change(base["lower"]), window)
    return change(base["forecast"]), pct, impact(upper, **how)
