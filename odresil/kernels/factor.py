"""Non-negative factorisation of one unit's matrix (rows: slots, columns: pairs), NumPy only.

Callers sort rows and columns first; results are deterministic."""

from __future__ import annotations

import numpy as np

TINY = 1e-9


def nndsvd(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starting factors from the leading singular pairs, keeping of each pair the sign with the larger mass."""
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    w, h = np.zeros((x.shape[0], k)), np.zeros((k, x.shape[1]))
    for j in range(min(k, len(s))):
        a, b = u[:, j], vt[j]
        best = max(((np.maximum(t * a, 0), np.maximum(t * b, 0)) for t in (1, -1)), key=lambda p: np.linalg.norm(p[0]) * np.linalg.norm(p[1]))
        na, nb = np.linalg.norm(best[0]), np.linalg.norm(best[1])
        if na > 0 and nb > 0:
            w[:, j], h[j] = np.sqrt(s[j] * na * nb) * best[0] / na, np.sqrt(s[j] * na * nb) * best[1] / nb
    return w, h


def sweep(w: np.ndarray, gram: np.ndarray, cross: np.ndarray, l1: float) -> float:
    """One pass of coordinate descent over the columns of ``w``; returns the projected gradient's total."""
    moved = 0.0
    for j in range(w.shape[1]):
        grad = w @ gram[:, j] - cross[:, j] + l1
        moved += np.abs(np.where(w[:, j] > 0, grad, np.minimum(grad, 0))).sum()
        if gram[j, j] > 0:
            w[:, j] = np.maximum(w[:, j] - grad / gram[j, j], 0)
    return moved


def nmf(x: np.ndarray, k: int, l1: float = 0.0, sweeps: int = 5000, tol: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Coordinate descent from ``nndsvd``, until the gradient is ``tol`` of the first one."""
    if k > min(x.shape):
        raise ValueError("more components than rows or columns")
    w, h = nndsvd(x, k)
    first = None
    for _ in range(sweeps):
        moved = sweep(w, h @ h.T, x @ h.T, l1)
        ht = np.ascontiguousarray(h.T)
        moved += sweep(ht, w.T @ w, x.T @ w, l1)
        h = ht.T
        first = first or moved
        if not moved or moved <= tol * first:
            break
    return w, h


def project(x: np.ndarray, h: np.ndarray, l1: float = 0.0, sweeps: int = 5000) -> np.ndarray:
    """The rows' weights under fixed ``h``, from zero."""
    w, first = np.zeros((x.shape[0], h.shape[0])), None
    gram, cross = h @ h.T, x @ h.T
    for _ in range(sweeps):
        moved = sweep(w, gram, cross, l1)
        first = first or moved
        if not moved or moved <= 1e-4 * first:
            break
    return w


def project_multiplicative(x: np.ndarray, h: np.ndarray, l1: float = 0.0, steps: int = 5000, tol: float = 1e-6, seed: int = 42) -> np.ndarray:
    """The rows' weights under fixed ``h`` by multiplicative updates; the objective, with its L1 part, is checked every ten."""
    rng = np.random.default_rng(seed)
    w = np.abs(rng.standard_normal((len(x), len(h)))) * (np.sqrt(np.abs(x).mean() / max(len(h), 1)) + TINY)
    gram, cross, last = h @ h.T, x @ h.T, None
    for step in range(steps):
        w *= cross / (w @ gram + l1 + TINY)
        if step % 10 == 0:
            loss = 0.5 * ((x - w @ h) ** 2).sum() + l1 * w.sum()
            if last is not None and abs(last - loss) < tol * (last + TINY):
                break
            last = loss
    return w


def nmf_context(x: np.ndarray, y: np.ndarray, mask: np.ndarray, k: int, strength: float = 1.0, l1: float = 0.0, steps: int = 5000, seed: int = 42):
    """Multiplicative updates of G, H, W for x ~ WH and, on the masked pairs, y ~ (G'H)'; y: [pairs, context].

    The context's weight is scaled to the matrices' sizes; checked every ten steps."""
    rng = np.random.default_rng(seed)
    y = y * mask[:, None]
    weight = strength * (x**2).sum() / ((y**2).sum() + TINY)
    w, h = nndsvd(x, k)
    w, h = w + TINY, h + TINY
    g = rng.random((k, y.shape[1])) + TINY
    last = np.inf
    for step in range(1, steps + 1):
        hm = h * mask
        g *= (h @ y) / (hm @ h.T @ g + TINY)
        h *= (w.T @ x + weight * g @ y.T) / (w.T @ w @ h + weight * (g @ g.T) @ hm + l1 + TINY)
        w *= (x @ h.T) / (w @ (h @ h.T) + l1 + TINY)
        if step % 10 == 0:
            loss = ((x - w @ h) ** 2).sum() + weight * ((y - (h * mask).T @ g) ** 2).sum() + 2 * l1 * (w.sum() + h.sum())
            if last - loss <= 1e-6 * max(last, TINY) and np.isfinite(last):
                break
            last = loss
    return w, h, g


def relative_error(x: np.ndarray, w: np.ndarray, h: np.ndarray) -> float:
    return float(np.linalg.norm(x - w @ h) / max(np.linalg.norm(x), TINY))


def ks_mean(x: np.ndarray, w: np.ndarray, h: np.ndarray) -> float:
    """Mean over slots of the largest gap between the distributions of observed and rebuilt flows."""
    out = []
    for a, b in zip(x, w @ h):
        grid = np.union1d(a, b)
        out.append(np.abs(np.searchsorted(np.sort(a), grid, "right") / len(a) - np.searchsorted(np.sort(b), grid, "right") / len(b)).max())
    return float(np.mean(out))


def masked_error(x: np.ndarray, k: int, seed: int, share: float = 0.1, rounds: int = 12, l1: float = 0.0, sweeps: int = 120) -> float:
    """Held-out-entry error: hides ``share`` of the cells, fills them in rounds, relative error on them.

    NaN where no cell or every cell is hidden, or the hidden ones are all zero."""
    hidden = np.random.default_rng(seed).random(x.shape) < share
    if not hidden.any() or hidden.all() or not x[hidden].any():
        return float("nan")
    filled = np.where(hidden, x[~hidden].mean(), x)
    for _ in range(rounds):
        w, h = nmf(filled, k, l1, sweeps=sweeps)
        filled = np.where(hidden, w @ h, x)
    return float(np.linalg.norm((x - filled)[hidden]) / np.linalg.norm(x[hidden]))
