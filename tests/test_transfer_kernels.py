"""Purpose spread, shape and city-wide shift: held-out guards, known answers and failure cases."""

import math

import numpy as np
import pytest

from odresil.kernels import backbone, baseline, citywide, factor, purpose, shape, solve


def units(n=6, seed=17, size=(5, 11)):
    rng = np.random.default_rng(seed)
    shares = {k: rng.dirichlet(np.ones(6), rng.integers(*size)) + rng.dirichlet(np.ones(6)) for k in range(n)}
    losses = {k: 2 * s[:, 0] * s[:, 1] + rng.normal(0, 0.3, len(s)) + k for k, s in shares.items()}
    return shares, losses


def entries(shares, losses):
    return {k: (shares[k], losses.get(k)) for k in shares}


def design(shares, losses):
    """Centred products and losses of units one after another, with weights by which every unit counts the same."""
    x, y, w = [], [], []
    for k in losses:
        i, j = np.triu_indices(6, 1)
        p = shares[k][:, i] * shares[k][:, j]
        x.append(p - p.mean(0))
        y.append(losses[k] - losses[k].mean())
        w.append(np.full(len(p), sum(map(len, losses.values())) / len(losses) / len(p)))
    return map(np.concatenate, (x, y, w))


def test_moments():
    shares, losses = units()
    bad = {**shares, 7: shares[0][:2], 8: np.where(np.arange(6) == 2, np.nan, shares[0])}
    m = purpose.moments(entries(bad, {**losses, 1: losses[1] * np.nan, 2: None}))
    assert m.names == [0, 1, 2, 3, 4, 5] and m.known.tolist() == [True, False, False, True, True, True]
    assert np.allclose(m.log_variance[0], np.log(np.mean((shares[0] - shares[0].mean(0)) ** 2, axis=0) + 1e-12))
    assert purpose.moments({}).names == []


def test_rules_equal_a_weighted_ridge_over_rows():
    shares, losses = units(5)
    m = purpose.moments(entries(shares, losses))
    got = purpose.rules(m, np.ones(5, bool))
    x, y, w = design(shares, losses)
    size = np.sqrt((w[:, None] * x**2).sum(0) / w.sum())
    for penalty, beta in zip(purpose.PENALTIES, got):
        z = x / size
        want = np.linalg.solve((z * w[:, None]).T @ z + penalty * np.eye(15), (z * w[:, None]).T @ y) / size
        assert np.allclose(beta, want, rtol=1e-6, atol=1e-8)


def test_the_penalty_predicts_left_out_units_best():
    shares, losses = units(5)
    m = purpose.moments(entries(shares, losses))
    error = np.zeros(13)
    for k in range(5):
        beta = purpose.rules(m, np.arange(5) != k)
        (x, y, _) = design({k: shares[k]}, {k: losses[k]})
        error += ((y[:, None] - x @ beta.T) ** 2).mean(0)
    assert purpose.rule(m, np.ones(5, bool))[1] == purpose.PENALTIES[error.argmin()]


def test_inputs_leave_the_unit_out():
    shares, losses = units()
    use = np.arange(6) != 0
    base = purpose.inputs(purpose.moments(entries(shares, losses)), use, 0)
    assert base.shape == (6, 7) and np.isfinite(base).all()
    moved = purpose.inputs(purpose.moments(entries(shares, {**losses, 3: losses[3][::-1] * 5})), use, 0)
    assert np.allclose(base[3], moved[3])  # its own losses do not shape its own input
    assert not np.allclose(base[0], moved[0]) and not np.allclose(base[1], moved[1])
    hidden = purpose.inputs(purpose.moments(entries(shares, {k: v for k, v in losses.items() if k})), use, 0)
    assert np.allclose(base[0], hidden[0])
    with pytest.raises(ValueError):
        purpose.inputs(purpose.moments(entries(shares, losses)), np.ones(6, bool), 0)


def test_multiplier():
    shares, losses = units(5)
    grid = np.linspace(0.01, 0.99, 60)
    full = entries(shares, {k: v for k, v in losses.items() if k})
    deviation = {k: 0.5 + 0.1 * k for k in full}
    factor, how = purpose.multiplier(0, full, deviation, grid, (0.4,), (0.0, 100.0))
    assert factor > 0 and math.isfinite(factor) and how["penalty"] in (0.0, 100.0) and len(how["effects"]) == 7
    assert purpose.multiplier(0, entries(shares, losses), deviation, grid, (0.4,), (0.0, 100.0)) == (factor, how)  # its losses are never read
    assert purpose.multiplier(0, {k: full[k] for k in (0, 1, 2, 3)}, deviation, grid, (0.4,), (0.0,))[0] == 1.0
    assert purpose.multiplier(9, full, deviation, grid, (0.4,), (0.0,))[0] == 1.0
    assert purpose.multiplier(0, full, {**deviation, 1: float("nan")}, grid, (0.4,), (0.0,))[1]["fallback"]


def test_backbone():
    days = np.arange(4.0)
    loss = backbone.losses(np.array([0.5, np.nan, 1.0, 0.0]), 0.7, days)
    assert loss[0] == pytest.approx(sum(1 - 1 / (1 + math.exp(-0.7 * d)) for d in range(4))) and loss[1] == pytest.approx(0) and len(loss) == 2
    assert backbone.deviation(np.array([0.5, 1.0]), 0.7, days) == pytest.approx(loss[0] / 2)
    assert math.isnan(backbone.deviation(np.array([0.5]), 0.7, days))


def test_predicted_shape():
    rng = np.random.default_rng(5)
    sizes = (5, 6, 7, 8, 6)
    losses = {k: rng.gamma(2, 1, n) for k, n in enumerate(sizes)}
    r0 = {k: rng.uniform(0.2, 0.9, n) for k, n in enumerate(sizes)} | {9: rng.uniform(0.2, 0.9, 4)}
    score = np.array([0.3, -1.0, 2.0, 0.3])
    guess = lambda known: shape.predicted(known, r0, lambda u: 0.4, np.arange(6.0), 9, score)
    found = guess(losses)
    assert len(found) == 4 and found[1] <= found[0] <= found[3] <= found[2]  # in the order of the scores, ties in their own
    assert np.array_equal(found, guess({**losses, 9: np.full(4, 99.0)}))  # the held unit's losses are never read
    with pytest.raises(shape.NoShape, match="fewer than 4"):
        guess({k: losses[k] for k in (0, 1, 2)})
    with pytest.raises(shape.NoShape, match="without spread"):
        guess({**losses, 2: np.ones(7)})
    with pytest.raises(shape.NoShape, match="backbone"):
        shape.predicted(losses, {**r0, 9: np.array([0.0, np.nan])}, lambda u: 0.4, np.arange(6.0), 9, score)


def test_steps_and_cells():
    edges = shape.partition([2, 3])
    assert edges == pytest.approx([0, 1 / 3, 1 / 2, 2 / 3, 1])
    m = shape.overlaps(2, edges)
    assert m.sum(1) == pytest.approx([0.5, 0.5]) and m.sum(0) == pytest.approx(np.diff(edges))
    assert np.array([1.0, 5.0]) @ m / np.diff(edges) == pytest.approx([1, 1, 5, 5])
    other = shape.overlaps(4, edges)  # steps that the partition does not refine
    assert other.sum(0) == pytest.approx(np.diff(edges)) and other[1] == pytest.approx([1 / 3 - 1 / 4, 1 / 2 - 1 / 3, 0, 0])
    assert shape.cells(np.array([3.0, 1.0, 2.0, 2.0]), np.array([0, 0.25, 0.5, 0.75, 1])).tolist() == [3, 0, 1, 2]


LOSS, BASE, LOADING, OWN = np.array([0.6, 0.2]), np.array([[8.0, 3.0], [7.0, 4.0], [9.0, 2.0]]), np.array([0.7, 1.4]), np.array([11.0, 12.0, 10.0])
CITY = citywide.City(BASE, LOADING, OWN)


def flat(losses):
    """Each component loses its total in equal parts."""
    return 1 - np.tile(losses / 3, (3, 1))


def lost(by):
    return float((1 - (flat(LOSS + by) * BASE) @ LOADING / OWN).sum())


@pytest.mark.parametrize("by", [0.45, -0.45, 3.0, -90.0, 200.0, 1.0])
def test_a_feasible_total_is_met(by):
    before = LOSS.copy()
    still, moved = citywide.nearest_shift(LOSS, lost(by), CITY, flat)
    assert abs(moved.gap) <= 1e-5 and moved.by == pytest.approx(by, abs=1e-4) and np.array_equal(before, LOSS)
    assert still.gap == pytest.approx(lost(0) - lost(by)) and np.allclose(moved.curves, flat(LOSS + moved.by))


def test_what_fits_is_left():
    calls = []
    still, moved = citywide.nearest_shift(LOSS, lost(0.0), CITY, lambda x: (calls.append(1), flat(x))[1])
    assert moved is still and moved.by == 0 and len(calls) == 1


def test_infeasible_total_keeps_the_best():
    bounded = lambda x: flat(np.clip(x, 0.1, 0.9))
    still, moved = citywide.nearest_shift(LOSS, 50.0, CITY, bounded)
    best = float((1 - (flat(np.array([0.9, 0.9])) * BASE) @ LOADING / OWN).sum()) - 50
    assert abs(moved.gap) <= abs(still.gap) and moved.gap == pytest.approx(best, abs=1e-6)
    # a least gap between the points of the grid is found
    bent = lambda x: flat(np.array([1.0, 1.0]) * (x[0] - 7.3) ** 2)
    assert citywide.nearest_shift(LOSS, lost(0) - 100, CITY, bent)[1].by == pytest.approx(6.7, abs=1e-3)


@pytest.mark.parametrize(
    "change",
    [
        {"wanted": float("nan")},
        {"own": np.array([11.0, 0.0, 10.0])},
        {"loading": -LOADING},
        {"base": BASE[:2]},
        {"losses": np.array([0.6, np.inf])},
        {"losses": np.array([0.6])},
        {"tolerance": 0.0},
        {"decode": lambda x: np.full((3, 2), np.nan)},
        {"decode": lambda x: np.ones((2, 2))},
    ],
)
def test_shifts_check_their_inputs(change):
    given = {"losses": LOSS, "wanted": 1.0, "base": BASE, "loading": LOADING, "own": OWN, "decode": flat, "tolerance": 1e-5} | change
    with pytest.raises(ValueError):
        city = citywide.City(given["base"], given["loading"], given["own"])
        citywide.nearest_shift(given["losses"], given["wanted"], city, given["decode"], given["tolerance"])


@pytest.mark.parametrize("r,n,p", [(0.0, 10, 1.0), (0.5, 12, 0.0978), (-0.8, 8, 0.01713), (0.95, 5, 0.01334), (1.0, 4, 0.0)])
def test_student_p(r, n, p):
    assert solve.student_p(r, n) == pytest.approx(p, rel=2e-3, abs=1e-12)


def test_recovery_fit_needs_its_first_day():
    days = np.arange(12.0)
    r = solve.curve(days, 0.4, 0.5, 1.1, 0.0, 1.0)
    alpha, level, strength, rate, r2 = solve.fit_recovery(days, r)
    assert r2 > 0.999 and level == pytest.approx(1.1, abs=0.05)
    plain = solve.fit_recovery(days, r, surge=False)
    assert plain[0] == pytest.approx(0.5, abs=0.02) and math.isnan(plain[2]) and math.isnan(plain[3])
    gap = r.copy()
    gap[0] = np.nan
    assert all(map(math.isnan, solve.fit_recovery(days, gap)))
    hole = r.copy()
    hole[5] = np.nan
    assert solve.fit_recovery(days, hole)[4] > 0.99


def test_decay_fit_skips_missing_days():
    t = np.arange(9.0)
    y = np.where(t <= 2, -0.2 * t, -0.4 * np.exp(-0.3 * (t - 2)))
    y[5] = np.nan
    depth, alpha, beta, t0 = solve.fit_decay(y)
    assert (t0, depth) == (2, pytest.approx(-0.4)) and alpha == pytest.approx(0.3, abs=1e-3) and beta == pytest.approx(-0.2)
    assert math.isnan(solve.fit_decay(np.full(3, np.nan))[0])


def test_refitted_folds_never_see_their_row():
    rng = np.random.default_rng(8)
    x, y = rng.normal(3, 2, (7, 2)), rng.normal(0, 1, 7)
    guess = solve.ridge_refit(x, y, 1.0)
    for k in range(7):
        rest = np.arange(7) != k
        z = (x[rest] - x[rest].mean(0)) / x[rest].std(0)
        beta = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y[rest] - y[rest].mean()))
        assert guess[k] == pytest.approx(y[rest].mean() + (x[k] - x[rest].mean(0)) / x[rest].std(0) @ beta)
    moved = y.copy()
    moved[4] = 50
    assert solve.ridge_refit(x, moved, 1.0)[4] == pytest.approx(guess[4])
    assert np.isnan(solve.ridge_refit(x[:1], y[:1], 1.0)).all()


def test_multiplicative_projection_is_a_least_squares_fit():
    rng = np.random.default_rng(2)
    h, w = rng.uniform(0, 1, (3, 40)), rng.uniform(0, 1, (12, 3))
    got = factor.project_multiplicative(w @ h, h, tol=1e-12)
    assert (got >= 0).all() and np.abs(got - w).max() < 0.02
    assert factor.project_multiplicative(w @ h, h, l1=5.0).sum() < got.sum()


def test_baseline_follows_trend_and_waves():
    t = np.arange(24 * 12)
    y = 50 + 0.02 * t + 8 * np.sin(2 * np.pi * t / 12) + 3 * np.cos(2 * np.pi * t / 84)
    base = baseline.forecast(y[:-24], 24, 12)
    assert np.abs(base["forecast"] - y[-24:]).max() < 1 and np.allclose(base["fit"] + base["noise"], y[:-24])
    assert (base["lower"] <= base["forecast"]).all() and (base["upper"] >= base["forecast"]).all()
    fallen = y.copy()
    fallen[-20:-8] *= 0.5
    change, smooth, found = baseline.decay(fallen, 24, 12, 2, buffer=0.05, method="consecutive", run=2)
    assert found["status"] == "Recovered" and found["start"] in (4, 5) and 14 <= found["end"] <= 18
    assert np.isnan(smooth[0]) and change[6] == pytest.approx(-0.5, abs=0.03)
    quiet = baseline.decay(y, 24, 12, 2, buffer=0.2)[2]
    assert quiet is None


@pytest.mark.parametrize("values", [[0, -0.2, -0.3, -0.1, 0.1, 0.2, 0.3], [-1, 1, -1, 1, 1], [0.1, -0.5, -0.4], [1, 1]])
@pytest.mark.parametrize("method", ["first_return", "consecutive", "end_of_series"])
def test_impact_of_an_array(values, method):
    found = baseline.impact(np.array(values, float), 0.05, method, 2)
    if min(values) >= -0.05:
        assert found is None
        return
    start = next(i for i, v in enumerate(values) if v < -0.05)
    end, status = len(values) - 1, "Ongoing" if method != "end_of_series" else "Fixed (End of Series)"
    need = 2 if method == "consecutive" else 1
    for i in range(start, len(values) - need + 1):
        if method != "end_of_series" and all(v >= 0 for v in values[i : i + need]):
            end, status = i, "Recovered"
            break
    assert found == {"last_normal": max(start - 1, 0), "start": start, "end": end, "status": status}


def test_scaling_and_procrustes():
    rng = np.random.default_rng(4)
    points = rng.normal(0, 1, (6, 2))
    distance = np.linalg.norm(points[:, None] - points[None], axis=2)
    found = solve.classical_scaling(distance)
    assert np.allclose(np.linalg.norm(found[:, None] - found[None], axis=2), distance)
    turned = 3 * found @ np.array([[0.6, -0.8], [0.8, 0.6]]) * [1, -1] + [5, -2]
    fitted, left = solve.procrustes(found, turned)
    assert np.allclose(fitted, turned) and left == pytest.approx(0, abs=1e-12)
    assert solve.procrustes(np.zeros((4, 2)), points[:4])[1] == 1.0
