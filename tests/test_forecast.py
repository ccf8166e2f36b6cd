"""Direct curves and the eight methods: known answers, held-out guards, metrics against plain sums."""

import numpy as np
import pandas as pd
import pytest

from odresil.kernels import direct, solve
from odresil.plans import QUERIES, forecast

SF = "/root/testdata/sf0.01"
DAYS = np.arange(6.0)


def cities(n=7, seed=2):
    """Cities whose rate follows their first feature."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    parameters = np.column_stack([0.6 + 0.15 * x[:, 0], np.full(n, 1.0), np.zeros(n), np.full(n, 0.5)])
    curves = np.array([solve.curve(DAYS, 0.4, *p) for p in parameters])
    return x, parameters, curves


def test_ridge_over_parameters():
    x, parameters, curves = cities()
    rest = np.arange(7) != 3
    curve, penalty = direct.ridge_curve(DAYS, x[rest], parameters[rest], curves[rest], x[3], 0.4)
    assert penalty == direct.PENALTIES[0] and np.abs(curve - curves[3]).max() < 0.02
    y = np.column_stack([x @ [1.0, -2.0, 0.5], np.full(7, 3.0)])
    got = direct.ridge(x[rest], y[rest], x[3], 1e-9)
    assert got == pytest.approx([y[3, 0], 3.0], abs=1e-5)  # a constant output stays


def test_mixture():
    x, _, curves = cities()
    near = direct.mixture(x, curves, x[2], 1e-3)
    assert np.allclose(near, curves[2]) and np.allclose(direct.mixture(x, curves, x[2], 1e6), curves.mean(0))
    assert np.allclose(direct.mixture(x, curves, x[2] + 1e9, 0.35), curves.mean(0))  # no weight is left
    guess, width = direct.kernel_curve(x[1:], curves[1:], x[0])
    error = [np.mean([direct.percent_error(direct.mixture(x[1:][np.arange(6) != k], curves[1:][np.arange(6) != k], x[1:][k], w), curves[1:][k]) for k in range(6)]) for w in direct.WIDTHS]
    assert width == direct.WIDTHS[int(np.argmin(error))] and (guess >= curves.min(0) - 1e-12).all() and (guess <= curves.max(0) + 1e-12).all()


def test_percent_error_and_bounds():
    assert direct.percent_error(np.array([1.1, np.nan, 2.0]), np.array([1.0, 1.0, 0.0])) == pytest.approx(10)
    assert direct.percent_error(np.array([np.nan]), np.array([1.0])) == np.inf
    assert direct.from_parameters(DAYS, 0.0, np.ones(4)).tolist() == [1.0] * 6
    assert np.array_equal(direct.from_parameters(DAYS, 0.5, np.array([99.0, 99.0, 99.0, 99.0])), solve.curve(DAYS, 0.5, *solve.HIGH))


@pytest.fixture(scope="module")
def table(spark):
    rows = forecast.curve_table(spark, SF).toPandas()
    rows["component"] = rows["component"].astype("int64")
    return rows


def test_a_fold_never_reads_what_it_predicts(table):
    """Of the held unit only first values, features, weights and baselines count."""
    held = table.unit.iloc[0]
    fold = table.assign(held=held)
    mine = fold.unit == held
    changed = fold.copy()
    changed["target"] = fold.target.where(~mine, np.arange(len(fold)) * -7.0)
    bend = lambda c: [c[0], *(None if v is None else v * 9 + 1 for v in list(c)[1:])]
    for name in ("curve", "city_curve"):
        changed[name] = [bend(c) if m else c for c, m in zip(fold[name], mine)]
    for name in ("city_alpha", "city_level"):
        changed[name] = fold[name].where(~mine, 3.3)
    a, b = forecast.evaluated(fold), forecast.evaluated(changed)
    assert len(a) == (mine.sum() + 1) * forecast.DAYS
    for x, y, component in zip(a.lines, b.lines, a.component):
        for method in set(forecast.METHODS) - {"oracle"}:
            assert (x[method] is None) == (y[method] is None) and (x[method] is None or x[method] == pytest.approx(y[method])), (method, component)


def test_lines_of_a_fold(table):
    fold = table.assign(held=table.unit.iloc[0])
    out = forecast.evaluated(fold)
    city = out[out.component.isna()]
    first = city[city.day == 0].iloc[0]
    for method in ("oracle", "train_mean", "naive_ridge", "city", "direct_ridge"):
        assert first.lines[method] == pytest.approx(first.truth, abs=0.05)  # anchored at the first day
    parts = out[out.component.notna()]
    assert all(line[m] is None for line in parts.lines for m in forecast.WHOLE) and all(line[m] is not None for line in parts.lines for m in forecast.BY_COMPONENT)


def test_metrics(spark):
    lines = lambda **known: {m: known.get(m) for m in forecast.METHODS}
    rows = [
        (1, None, 0, 1.0, lines(pred=1.5, city=1.0)),
        (1, None, 1, 2.0, lines(pred=1.0, city=None)),
        (2, None, 0, 0.0, lines(pred=0.5, city=0.5)),
        (2, None, 1, None, lines(pred=0.5, city=0.5)),
        (2, 7, 0, 4.0, lines(pred=3.0)),
    ]
    df = spark.createDataFrame(rows, f"held long, component long, day int, truth double, lines struct<{forecast.LINES}>")
    got = {(r.level, r.method): r for r in forecast.metrics(df).collect()}
    assert set(got) == {("city", "pred"), ("city", "city"), ("component", "pred")}
    pred = got["city", "pred"]
    assert (pred.n_units, pred.n) == (2, 3) and pred.mae == pytest.approx(2 / 3) and pred.mape == pytest.approx(50) and pred.bias == pytest.approx(0) and pred.loss_error == pytest.approx(0.5)
    assert got["city", "city"].n == 2 and got["component", "pred"].bias == -1


def test_queries(spark):
    rows = QUERIES["curve_methods"](spark, SF).toPandas()
    city = rows[rows.component.isna()]
    assert city.groupby("held").size().eq(forecast.DAYS).all() and city[list(forecast.METHODS)].notna().all().all()
    out = QUERIES["curve_method_metrics"](spark, SF).toPandas()
    assert set(out[out.level == "city"].method) == set(forecast.METHODS) and set(out[out.level == "component"].method) == set(forecast.BY_COMPONENT)
    for method in forecast.METHODS:
        gap = city[method] - city.truth
        row = out[(out.level == "city") & (out.method == method)].iloc[0]
        assert row.mae == pytest.approx(gap.abs().mean()) and row.bias == pytest.approx(gap.mean(), abs=1e-12)
    direct_rows = QUERIES["direct_city_curves"](spark, SF).toPandas()
    both = direct_rows.merge(city, on=["held", "day"])
    assert len(both) == len(city) and np.allclose(both.ridge, both.direct_ridge) and np.allclose(both.kernel, both.direct_kernel) and direct_rows.width.isin(direct.WIDTHS).all()
    assert pd.notna(direct_rows.penalty).all()
