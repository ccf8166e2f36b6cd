"""Kernels against dense formulas and invariants."""

import numpy as np
import pytest

from odresil.kernels import factor, solve

RNG = np.random.default_rng(7)


def test_nmf_recovers_low_rank():
    x = RNG.random((40, 3)) @ RNG.random((3, 25))
    w, h = factor.nmf(x, 3, sweeps=2000, tol=1e-7)
    assert (w >= 0).all() and (h >= 0).all() and factor.relative_error(x, w, h) < 0.02
    assert factor.relative_error(x, factor.project(x, h), h) < 0.02
    with pytest.raises(ValueError):
        factor.nmf(x, 30)


def test_context_factorisation():
    x, y = RNG.random((30, 20)), RNG.random((20, 4))
    w, h, g = factor.nmf_context(x, y, np.ones(20), 4)
    assert (w >= 0).all() and (g >= 0).all() and factor.relative_error(x, w, h) < 0.6
    again = factor.nmf_context(x, y, np.ones(20), 4)
    assert (again[0] == w).all()


def test_masked_error_prefers_true_rank():
    x = RNG.random((40, 2)) @ RNG.random((2, 30))
    assert factor.masked_error(x, 2, 1) < factor.masked_error(x, 1, 1)


def test_ridge():
    x, y, w = RNG.normal(size=(30, 4)), RNG.normal(size=30), RNG.random(30) + 0.1
    for a, beta in zip((0.1, 10), solve.ridge_path(x, y, w, (0.1, 10))):
        assert beta == pytest.approx(np.linalg.solve((x.T * w) @ x + a * np.eye(4), (x.T * w) @ y))

    def loo(a):
        out = 0.0
        for i in range(30):
            k = np.arange(30) != i
            m, c = x[k].mean(0), y[k].mean()
            b = np.linalg.solve((x[k] - m).T @ (x[k] - m) + a * np.eye(4), (x[k] - m).T @ (y[k] - c))
            out += (y[i] - c - (x[i] - m) @ b) ** 2
        return out

    a, _, _ = solve.ridge_loo(x, y, (0.01, 1.0, 100.0))
    assert loo(a) == min(map(loo, (0.01, 1.0, 100.0)))


def test_roots_and_minima():
    assert solve.bisect(lambda x: x**3 - 2, 0, 3) == pytest.approx(2 ** (1 / 3))
    assert solve.bisect(lambda x: x + 5, 0, 3) == 0
    p, v = solve.nelder_mead(lambda p: (p[0] - 1) ** 2 + 3 * (p[1] + 2) ** 2, [0.0, 0.0])
    assert p == pytest.approx([1, -2], abs=1e-3) and v < 1e-5


def test_monotone():
    y = RNG.normal(size=50)
    out = solve.monotone(y)
    assert (np.diff(out) >= -1e-12).all() and out.sum() == pytest.approx(y.sum())
    assert solve.monotone(np.sort(y)) == pytest.approx(np.sort(y))


def test_recovery_fit():
    days = np.arange(12.0)
    fit = solve.fit_recovery(days, solve.curve(days, 0.4, 0.5, 1.1, 0.1, 0.6))
    assert fit[4] > 0.99
    assert np.isnan(solve.fit_recovery(days, np.ones(12))).all() and np.isnan(solve.fit_recovery(days, np.r_[0.0, np.ones(11)])).all()


def test_decay_fit():
    t = np.arange(10.0)
    y = np.where(t <= 3, -0.2 * t, -0.6 * np.exp(-0.4 * (t - 3)))
    depth, alpha, beta, t0 = solve.fit_decay(y)
    assert (t0, depth, beta) == (3, pytest.approx(-0.6), pytest.approx(-0.2)) and alpha == pytest.approx(0.4, abs=1e-3)


def test_communities():
    a = np.kron(np.eye(3), np.ones((4, 4))) + 0.01
    assert solve.communities(a).tolist() == [0] * 4 + [1] * 4 + [2] * 4
