"""The plain logistic recovery that first values alone imply, and how far its losses spread."""

from __future__ import annotations

import numpy as np

#: First values up to this one imply no curve (fixed value).
LEAST_START = 1e-6


def losses(start: np.ndarray, alpha: float, days: np.ndarray) -> np.ndarray:
    """What the logistic to 1 loses over the days from each usable first value."""
    odds = 1 / start[np.isfinite(start) & (start > LEAST_START)] - 1
    growth = np.exp(-alpha * days)
    missing = odds[:, None] * growth / (1 + odds[:, None] * growth)
    return missing.sum(1)


def deviation(start: np.ndarray, alpha: float, days: np.ndarray) -> float:
    """Population deviation of these losses; missing for fewer than two."""
    found = losses(start, alpha, days)
    return float(np.std(found)) if found.size >= 2 else float("nan")
