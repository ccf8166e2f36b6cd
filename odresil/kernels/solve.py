"""Small solvers on at most a few hundred numbers, NumPy only: ridge, bounded least squares, roots, monotone fits, communities."""

from __future__ import annotations

import numpy as np


def ridge_path(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalties) -> np.ndarray:
    """Weighted ridge coefficients for every penalty from one eigen-decomposition; no intercept."""
    values, vectors = np.linalg.eigh((x * w[:, None]).T @ x)
    side = vectors.T @ ((x * w[:, None]).T @ y)
    return np.stack([vectors @ (side / (values + a)) for a in penalties])


def ridge_loo(x: np.ndarray, y: np.ndarray, penalties) -> tuple[float, np.ndarray, float]:
    """(penalty, coefficients, intercept) of least leave-one-out squared error, the first of equally good ones."""
    mx, my = x.mean(0), y.mean()
    u, s, vt = np.linalg.svd(x - mx, full_matrices=False)
    best = None
    for a in penalties:
        shrink = s**2 / (s**2 + a)
        hat = (u**2 * shrink).sum(1) + 1 / len(y)
        fit = my + u @ (shrink * (u.T @ (y - my)))
        error = float((((y - fit) / np.maximum(1 - hat, 1e-12)) ** 2).sum())
        if best is None or error < best[0]:
            beta = vt.T @ ((s / (s**2 + a)) * (u.T @ (y - my)))
            best = (error, a, beta)
    return best[1], best[2], float(my - mx @ best[2])


def ridge_refit(x: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    """Leave-one-out predictions; scaler, means and coefficients come from the other rows each time."""
    out = np.full(len(y), np.nan)
    for k in range(len(y) if len(y) > 1 else 0):
        rest = np.arange(len(y)) != k
        mean, sd = x[rest].mean(0), x[rest].std(0)
        sd = np.where(sd > 0, sd, 1.0)
        z, t = (x[rest] - mean) / sd, y[rest] - y[rest].mean()
        beta = np.linalg.solve(z.T @ z + penalty * np.eye(x.shape[1]), z.T @ t)
        out[k] = y[rest].mean() + (x[k] - mean) / sd @ beta
    return out


def least_squares(residual, start, low, high, steps: int = 80) -> tuple[np.ndarray, float]:
    """Levenberg-Marquardt with numeric slopes, clipped to the bounds: (parameters, sum of squares)."""
    low, high = np.asarray(low, float), np.asarray(high, float)
    p = np.clip(np.asarray(start, float), low, high)
    r = residual(p)
    cost, damp = float(r @ r), 1e-2
    for _ in range(steps):
        h = 1e-6 * np.maximum(np.abs(p), 1e-2) * np.where(p + 1e-6 * np.maximum(np.abs(p), 1e-2) > high, -1, 1)
        jac = np.stack([(residual(p + np.eye(len(p))[i] * h[i]) - r) / h[i] for i in range(len(p))], 1)
        normal, grad = jac.T @ jac, jac.T @ r
        moved = False
        for _ in range(8):
            step = np.linalg.lstsq(normal + damp * np.diag(np.diag(normal) + 1e-9), -grad, rcond=None)[0]
            q = np.clip(p + step, low, high)
            s = residual(q)
            if float(s @ s) < cost:
                moved, gain = True, cost - float(s @ s)
                p, r, cost, damp = q, s, float(s @ s), damp / 4
                break
            damp *= 4
        if not moved or gain <= 1e-12 * max(cost, 1e-12):
            break
    return p, cost


def bisect(f, low: float, high: float, steps: int = 80) -> float:
    """A root of a function with a change of sign between ``low`` and ``high``; the nearer end without one."""
    a, b = f(low), f(high)
    if a == 0 or b == 0 or (a > 0) == (b > 0):
        return low if abs(a) <= abs(b) else high
    for _ in range(steps):
        mid = (low + high) / 2
        if (f(mid) > 0) == (a > 0):
            low = mid
        else:
            high = mid
    return (low + high) / 2


def golden(f, low: float, high: float, steps: int = 60) -> float:
    """The least point of a function with one minimum between ``low`` and ``high``."""
    for _ in range(steps):
        a, b = low + (high - low) * 0.381966, low + (high - low) * 0.618034
        low, high = (low, b) if f(a) <= f(b) else (a, high)
    return (low + high) / 2


def nelder_mead(f, start, steps: int = 400, xtol: float = 1e-4, ftol: float = 1e-7) -> tuple[np.ndarray, float]:
    """Simplex minimisation without slopes."""
    return nelder_mead_checked(f, start, steps, xtol, ftol)[:2]


def nelder_mead_checked(f, start, steps: int = 400, xtol: float = 1e-4, ftol: float = 1e-7) -> tuple[np.ndarray, float, bool]:
    """The same with whether it ended within its tolerances."""
    converged = False
    start = np.asarray(start, float)
    points = [start] + [start + np.eye(len(start))[i] * (0.05 * start[i] if start[i] else 0.1) for i in range(len(start))]
    simplex = sorted(((f(p), tuple(p)) for p in points))
    for _ in range(steps):
        values, corners = np.array([v for v, _ in simplex]), np.array([p for _, p in simplex])
        if np.abs(corners[1:] - corners[0]).max() <= xtol and values[-1] - values[0] <= ftol:
            converged = True
            break
        centre, worst = corners[:-1].mean(0), corners[-1]
        tries = {t: centre + t * (centre - worst) for t in (1.0, 2.0, 0.5, -0.5)}
        one = f(tries[1.0])
        if one < values[0]:
            two = f(tries[2.0])
            new = (two, tries[2.0]) if two < one else (one, tries[1.0])
        elif one < values[-2]:
            new = (one, tries[1.0])
        else:
            t = 0.5 if one < values[-1] else -0.5
            half = f(tries[t])
            new = (half, tries[t]) if half < min(one, values[-1]) else None
        if new is None:
            simplex = [simplex[0]] + [(f(q), tuple(q)) for q in (corners[0] + (corners[1:] - corners[0]) / 2)]
        else:
            simplex[-1] = (new[0], tuple(new[1]))
        simplex.sort()
    return np.array(simplex[0][1]), float(simplex[0][0]), converged


def monotone(y: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """The non-decreasing sequence nearest to ``y`` in weighted squares."""
    w = np.ones(len(y)) if w is None else w
    pools: list[list[float]] = []
    for v, m in zip(y, w):
        pools.append([v, m, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            v2, m2, n2 = pools.pop()
            v1, m1, n1 = pools[-1]
            pools[-1] = [(v1 * m1 + v2 * m2) / (m1 + m2), m1 + m2, n1 + n2]
    return np.concatenate([np.full(int(n), v) for v, _, n in pools]) if pools else np.empty(0)


def communities(a: np.ndarray, gamma: float = 1.0) -> np.ndarray:
    """Labels of least-index order from local moves on modularity, repeated on merged nodes (no randomness)."""
    a = np.maximum((a + a.T) / 2, 0)
    np.fill_diagonal(a, 0)
    label = np.arange(len(a))
    total = a.sum()
    if total <= 0:
        return label
    graph, member = a.copy(), np.arange(len(a))
    while True:
        own = np.arange(len(graph))
        degree, moved = graph.sum(1), True
        while moved:
            moved = False
            for i in range(len(graph)):
                links = np.array([graph[i, (own == c) & (np.arange(len(own)) != i)].sum() for c in range(len(graph))])
                mass = np.array([degree[(own == c) & (np.arange(len(own)) != i)].sum() for c in range(len(graph))])
                gain = links - gamma * degree[i] * mass / total
                c = int(gain.argmax())
                if gain[c] > gain[own[i]] + 1e-12:
                    own[i], moved = c, True
        kinds, own = np.unique(own, return_inverse=True)
        member = own[member]
        if len(kinds) == len(graph):
            break
        fold = np.eye(len(kinds))[own]
        graph = fold.T @ graph @ fold
    first = {}
    return np.array([first.setdefault(c, len(first)) for c in member.tolist()])


def curve(days: np.ndarray, r0: float, alpha: float, level: float, strength: float = 0.0, rate: float = 0.0) -> np.ndarray:
    """Logistic recovery with a surge."""
    return level / (1 + (level / r0 - 1) * np.exp(-alpha * days)) + strength * days * np.exp(-rate * days)


#: Starts (None: the mean of the last three values) and bounds of rate, level, surge strength and surge rate (fixed values).
STARTS = ((0.3, None, 0.0, 0.5), (0.5, 1.0, 2.0, 0.3), (0.5, 1.0, -1.0, 0.5), (1.0, None, 1.0, 1.0), (0.2, None, 0.5, 0.2))
PLAIN = ((0.3, None), (0.5, 1.0), (1.0, None))
LOW, HIGH = (0.0, 0.05, -10.0, 0.1), (5.0, 5.0, 10.0, 3.0)


def fit_recovery(days: np.ndarray, r: np.ndarray, surge: bool = True):
    """(alpha, level, strength, rate, r2) of the best of several bounded fits; all missing where the curve says too little.

    The curve starts from the value of the first day, which must be there.  Without ``surge`` the pulse is left out."""
    missing = (np.nan,) * 5
    order = np.argsort(days)
    days, r = days[order], r[order]
    if not len(r) or not np.isfinite(r[0]):
        return missing
    start, ok = r[0], np.isfinite(r)
    days, r = days[ok], r[ok]
    if start <= 1e-6 or len(r) < 5 or r.std() < 0.02:
        return missing
    end = float(np.clip(r[-3:].mean(), 0.05, 5))
    n = 4 if surge else 2
    pulse = (0.0, 1.0) if not surge else ()
    starts = [[end if v is None else v for v in s[:n]] for s in (STARTS if surge else PLAIN)]
    fits = [least_squares(lambda p: curve(days, start, *p, *pulse) - r, s, LOW[:n], HIGH[:n]) for s in starts]
    p, cost = min(fits, key=lambda f: f[1])
    r2 = 1 - cost / ((r - r.mean()) ** 2).sum()
    return (*map(float, p), *((np.nan, np.nan) if not surge else ()), float(r2)) if r2 >= 0 else missing


def fit_decay(y: np.ndarray):
    """(depth, alpha, beta, t0): straight fall to the first minimum, then exponential return with alpha in [0, 2].

    Missing values are left out of the fit; without a value there is none."""
    seen = np.isfinite(y)
    if not seen.any():
        return np.nan, np.nan, np.nan, 0
    t0 = int(np.nanargmin(y))
    depth, t = float(y[t0]), np.arange(len(y), dtype=float)
    beta = depth / t0 if t0 else 0.0

    def loss(alpha):
        model = np.where(t <= t0, beta * t if t0 else depth, depth * np.exp(-alpha * (t - t0)))
        return float(((model - y)[seen] ** 2).sum())

    grid = np.linspace(0, 2, 41)
    k = int(np.argmin([loss(a) for a in grid]))
    return depth, golden(loss, grid[max(k - 1, 0)], grid[min(k + 1, 40)]), beta, t0


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    from math import exp, lgamma, log, log1p

    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) / a
    value, c, d = 1.0, 1.0, 0.0
    for k in range(1, 600):
        m = k // 2
        if k % 2:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / (1 + term * d or 1e-300)
        c = 1 + term / c or 1e-300
        value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front / value


def student_p(r: float, n: int) -> float:
    """Two-sided p of a correlation of n pairs."""
    if abs(r) >= 1:
        return 0.0
    return incomplete_beta((n - 2) / 2, 0.5, 1 - r * r)


def classical_scaling(distance: np.ndarray, k: int = 2) -> np.ndarray:
    """Points in ``k`` dimensions whose distances are nearest to the given ones, each axis with its largest entry positive."""
    n = len(distance)
    centre = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-centre @ distance**2 @ centre / 2)
    top = np.argsort(-values, kind="stable")[:k]
    points = vectors[:, top] * np.sqrt(np.maximum(values[top], 0))
    signs = np.sign(points[np.abs(points).argmax(0), np.arange(points.shape[1])])
    return points * np.where(signs == 0, 1, signs)


def procrustes(points: np.ndarray, onto: np.ndarray) -> tuple[np.ndarray, float]:
    """The points moved, turned, mirrored and scaled onto others, and the share of squared distance left."""
    a, b = points - points.mean(0), onto - onto.mean(0)
    if not (a**2).sum() or not (b**2).sum():
        return np.tile(onto.mean(0), (len(points), 1)), 1.0
    u, s, vt = np.linalg.svd(a.T @ b)
    scale = s.sum() / (a**2).sum()
    fitted = scale * a @ u @ vt
    return fitted + onto.mean(0), float(((fitted - b) ** 2).sum() / (b**2).sum())
