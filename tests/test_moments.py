"""Ridge and axes from sums of products against the one-task kernel and plain refits."""

import numpy as np
import pandas as pd
import pytest

from odresil.kernels import solve
from odresil.operators import moments

NAMES = [f"f{k}" for k in range(24)]
PENALTIES = np.logspace(-3, 3, 13)


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(8)
    sizes = {"a": 40, "b": 7, "c": 3, "d": 11}
    rows = []
    for unit, n in sizes.items():
        x = rng.normal(size=(n, 24)) @ np.diag(np.linspace(0.2, 3, 24))
        x[:, 5] = x[:, 3] + x[:, 4]  # collinear
        y = x[:, 0] - 2 * x[:, 7] + rng.normal(size=n)
        rows += [(unit, *map(float, r), float(v)) for r, v in zip(x, y)]
    return pd.DataFrame(rows, columns=["unit", *NAMES, "y"])


def training(frame, mode, fold):
    return frame if mode == "pooled" else frame[(frame.unit == fold) == (mode == "within")]


@pytest.mark.parametrize("mode", moments.MODES)
@pytest.mark.parametrize("scaled", [(), ("f2",)])
def test_ridge_like_the_kernel(spark, frame, mode, scaled, monkeypatch):
    monkeypatch.setattr(moments, "BLOCK", 3)  # folds come in blocks
    fits = moments.ridge(spark.createDataFrame(frame).repartition(5), "unit", NAMES, "y", PENALTIES, mode, scaled).collect()
    assert {r.fold for r in fits} == ({None} if mode == "pooled" else set(frame.unit))
    for r in fits:
        part = training(frame, mode, r.fold)
        x = part[NAMES].to_numpy().copy()
        scale = np.ones(24)
        for n in scaled:
            scale[NAMES.index(n)] = part[n].std(ddof=0)
        penalty, beta, start = solve.ridge_loo(x / scale, part.y.to_numpy(), PENALTIES)
        assert r.penalty == pytest.approx(penalty) and np.allclose(r.beta, beta / scale, atol=1e-9) and r.intercept == pytest.approx(start, abs=1e-9)


def test_penalty_has_the_least_error_of_plain_refits(spark, frame):
    """Each row is predicted by a fit without it, for each penalty."""
    got = moments.ridge(spark.createDataFrame(frame), "unit", NAMES, "y", PENALTIES, "without").where("fold = 'a'").first()
    part = frame[frame.unit != "a"]
    x, y, errors = part[NAMES].to_numpy(), part.y.to_numpy(), []
    for a in PENALTIES:
        error = 0.0
        for k in range(len(y)):
            rest = np.arange(len(y)) != k
            # one centre for all folds of the shortcut: the intercept is a column that has no penalty
            z = np.column_stack([np.ones(len(y)), x])
            beta = np.linalg.solve(z[rest].T @ z[rest] + np.diag([0.0] + [a] * 24), z[rest].T @ y[rest])
            error += (y[k] - z[k] @ beta) ** 2
        errors.append(error)
    assert got.penalty == pytest.approx(PENALTIES[int(np.argmin(errors))])


def test_scores_and_odd_tables(spark, frame):
    rows = spark.createDataFrame(frame)
    fits = moments.ridge(rows, "unit", NAMES, "y", PENALTIES, "without")
    scores = moments.scored(rows, "unit", NAMES, fits)
    by = {r.fold: r for r in fits.collect()}
    for r in scores.collect():
        f = by[r.unit]
        assert r.score == pytest.approx(f.intercept + sum(b * r[n] for b, n in zip(f.beta, NAMES)))
    assert scores.columns == [*frame.columns, "score"]
    alone = spark.createDataFrame(frame[frame.unit == "a"])
    assert moments.ridge(alone, "unit", NAMES, "y", PENALTIES, "without").collect() == []
    for mode in moments.MODES:
        assert moments.ridge(rows.limit(0), "unit", NAMES, "y", PENALTIES, mode).collect() == []
    with pytest.raises(ValueError, match="mode"):
        moments.ridge(rows, "unit", NAMES, "y", PENALTIES, "other")


def test_axes_like_a_decomposition(spark, frame):
    rows = spark.createDataFrame(frame).repartition(3)
    mean, axes, shares = moments.axes(rows, "unit", NAMES, "y", 3)
    x = frame[NAMES].to_numpy()
    _, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(mean, x.mean(0)) and np.allclose(np.abs(axes @ v[:3].T), np.eye(3), atol=1e-8) and np.allclose(shares, s[:3] ** 2 / (s**2).sum())
    out = moments.projected(rows, NAMES, mean, axes, ["p", "q", "r"]).toPandas()
    assert np.allclose(out[["p", "q", "r"]].var(ddof=0), s[:3] ** 2 / len(x))
    assert moments.axes(rows.limit(0), "unit", NAMES, "y")[1].shape == (0, 24)


def test_standard_scores(spark, frame):
    out = moments.standardised(spark.createDataFrame(frame.assign(f1=2.0)), "unit", ["f0", "f1"]).toPandas()
    assert np.allclose(out.groupby("unit").f0.mean(), 0) and np.allclose(out.groupby("unit").f0.std(ddof=0), 1) and np.allclose(out.f1, 0, atol=1e-3)
