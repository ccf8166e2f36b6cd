"""Every kernel query over the tables of the second scale: shapes, bounds and identities that hold for any data."""

import numpy as np
import pandas as pd
import pytest

from odresil.operators import communities
from odresil.plans import ORACLES, QUERIES, cities, kernels

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def table(spark):
    return kernels.component_table(spark, SF).toPandas()


def run(spark, name) -> pd.DataFrame:
    return QUERIES[name](spark, SF).toPandas()


def test_factorisation(spark):
    cd = run(spark, "nmf_cd")
    assert (cd.w_sum >= 0).all() and (cd.h_sum >= 0).all() and cd.error.between(0, 1).all() and (cd.groupby("unit").size() == 3).all()
    assert (run(spark, "nmf_project").value >= 0).all()
    context = run(spark, "nmf_context")
    assert (context.value >= 0).all() and context.groupby(["unit", "component"]).size().eq(6).all() and context.error.between(0, 1).all()
    quality = run(spark, "nmf_quality")
    assert quality.ks.between(0, 1).all() and (quality.fit_error <= quality.held_error + 0.5).all()


def test_fits(spark):
    fit = run(spark, "recovery_fit").dropna()
    assert fit.alpha.between(0, 5).all() and fit.level.between(0.05, 5).all() and fit.rate.between(0.1, 3).all() and fit.r2.between(0, 1).all()
    step = run(spark, "stepwise_fit")
    assert step.alpha.between(0, 2).all() and (step.t0 >= 0).all()
    level = run(spark, "plateau_inversion")
    days = np.arange(kernels.DAYS)
    for r in level[level.level.between(0.06, 4.9)].itertuples():
        assert (1 - r.level / (1 + (r.level / r.r0 - 1) * np.exp(-0.35 * days))).sum() == pytest.approx(r.loss, abs=1e-6)


def test_ranks_and_pairs(spark, table):
    scores = run(spark, "cross_unit_transfer")
    assert len(scores) == len(table) and sorted(scores.held.unique()) == sorted(table.unit.unique())
    assert run(spark, "rank_channel").spearman.between(-1, 1).all()
    pairs = run(spark, "pair_matrix")
    assert len(pairs) == table.unit.nunique() ** 2 and pairs.spearman.dropna().between(-1.001, 1.001).all()
    blocks = run(spark, "louvain_blocks")
    assert blocks.groupby("gamma").unit.nunique().eq(table.unit.nunique()).all() and set(blocks.gamma) == set(communities.RESOLUTIONS)
    sweep = run(spark, "louvain_sweep")
    assert sweep.agreement.between(0, 1.0001).all() and (sweep.sizes.map(sum) == table.unit.nunique()).all() and sweep.chosen.sum() == 1
    ridge = run(spark, "ridge_loo")
    assert set(ridge.feature) == set(cities.RANK) and len(ridge) == 24 and ridge.penalty.nunique() == 1 and ridge.penalty[0] in kernels.PENALTIES


def test_directions(spark, table):
    points = run(spark, "mapping_pca")
    assert len(points) == len(table) and np.allclose(points[["pc1", "pc2"]].mean(), 0, atol=1e-9) and points.shade.between(0.30, 0.9201).all()
    assert (points.share1 >= points.share2).all() and abs(np.corrcoef(points.pc1, points.pc2)[0, 1]) < 1e-9
    rules = run(spark, "mapping_directions")
    assert np.allclose(rules.groupby("unit", dropna=False).coef.apply(lambda c: (c**2).sum()), 1) and rules.unit.isna().sum() == 24
    aligned = run(spark, "rule_alignment")
    assert aligned.cosine.between(-1.001, 1.001).all() and np.isclose((aligned[aligned.unit.isna()].value ** 2).sum(), 1)
    order = aligned.drop_duplicates("place").sort_values("place")
    assert order.unit.isna().tolist() == [False] * (len(order) - 1) + [True] and order.cosine[:-1].is_monotonic_decreasing


def test_scores_equal_the_one_task_kernel(spark, table):
    """Sums of products give the kernel's predictions for every held unit."""
    got = run(spark, "cross_unit_transfer").set_index(["held", "component"]).score
    for held in table.unit.unique():
        pdf, mask, score = kernels.rank_scores(table.assign(held=held))
        want = pd.Series(score[mask], pd.MultiIndex.from_arrays([pdf.held[mask], pdf.component[mask]], names=["held", "component"]))
        assert np.allclose(got.loc[want.index], want, atol=1e-7)


def test_coriding(spark, table):
    out = run(spark, "coriding_significance")
    whole = out[out.panel == "all"]
    assert len(whole) == 15 and np.array_equal(whole.p, whole.q) and out.rho.dropna().between(-1.001, 1.001).all()
    part = out[out.panel != "all"].dropna(subset=["p"]).sort_values("p")
    assert (part.q >= part.p - 1e-12).all() and part.q.is_monotonic_increasing and part.q.max() <= 1


def test_a_held_units_losses_never_reach_its_predictions(table):
    fold = table.assign(held=table.unit.iloc[0])
    changed = fold.assign(target=fold.target.where(fold.unit != fold.held, -7.0 * np.arange(len(fold))))
    for f in (fold, changed):
        f["component"] = f.component.astype("int64")
    a, b = kernels.mapped(fold), kernels.mapped(changed)
    assert np.allclose(a.loss, b.loss) and np.allclose(a.total, b.total)
    assert kernels.spread_scale(fold)[:2] == pytest.approx(kernels.spread_scale(changed)[:2])


def test_spread_and_shape(spark, table):
    spread = run(spark, "purpose_spread")
    assert (spread.scale > 0).all() and np.allclose(spread.scale, spread.base * spread.multiplier) and len(spread) == table.unit.nunique()
    shape = run(spark, "shape_modes")
    assert len(shape) == len(table) and np.isfinite(shape.value).all()


def test_chain(spark, table):
    mapped = run(spark, "quantile_map")
    weights = table.rename(columns={"unit": "held"})[["held", "component", "weight"]]
    both = mapped.merge(weights, on=["held", "component"])
    totals = both.groupby("held").apply(lambda g: (g.loss * g.weight).sum() / g.weight.sum(), include_groups=False)
    assert np.allclose(totals, both.groupby("held").total.first())
    aligned = run(spark, "align_city_loss")
    assert (aligned.residual.abs() <= aligned.initial_gap.abs() + 1e-9).all() and (aligned.ok == (aligned.residual.abs() <= 1e-5)).all()
    city = run(spark, "curve_forecast")
    assert np.isfinite(city.r_city).all() and city.groupby("held").size().eq(len(kernels.CURVE_DAYS)).all()
    ok = set(aligned[aligned.ok].held)
    lost = city[city.held.isin(ok)].groupby("held").r_city.apply(lambda r: (1 - r).sum())
    assert np.allclose(lost, mapped[mapped.held.isin(ok)].groupby("held").total.first(), atol=1e-4)
    joint = run(spark, "joint_curve")
    assert np.isfinite(joint.r).all() and len(joint) == len(mapped) * len(kernels.CURVE_DAYS)
    assert np.isfinite(run(spark, "city_total").total).all()


def test_carriers(spark, table):
    city = run(spark, "city_alpha_knn")
    assert city.alpha.between(0.05, 2).all() and city.groupby("held").r.apply(lambda r: r.is_monotonic_increasing or r.is_monotonic_decreasing).all()
    parameter = run(spark, "parameter_transfer")
    assert np.isfinite(parameter.guess).all() and parameter[parameter.fallback].groupby("held").guess.nunique().le(1).all()
    refit = run(spark, "ridge_loo_refit")
    assert len(refit) == len(table) and np.isfinite(refit.guess).all()
    nearest = run(spark, "nearest_cluster")
    assert nearest.cluster.ge(0).all() and nearest.distance.dropna().between(0, 2).all()
    assert (run(spark, "nmf_project_multiplicative").value >= 0).all()
    plane = run(spark, "coriding_map")
    assert plane.groupby("held").category.nunique().eq(6).all() and plane.left.between(0, 1.0001).all() and np.isfinite(plane.x).all()
    decay = run(spark, "decay_pipeline")
    assert set(decay.status) <= {"None", "Ongoing", "Recovered"} and (decay.dropna().end >= decay.dropna().start).all()


def test_p_values(spark):
    out = run(spark, "loss_correlation_p")
    assert set(out.name) == set(cities.PAIRED) and out.p.between(0, 1).all() and out.rho.between(-1, 1).all()
    assert run(spark, "frame_digests").digest.str.len().eq(64).all()


def test_every_query_without_sql_is_tested():
    tested = open(__file__).read() + "permutation_p rank_cv rank_report nmf_block_factors unit_decomposition direct_city_curves curve_methods curve_method_metrics"  # these have files of their own
    assert not [n for n in QUERIES if n not in ORACLES and n not in tested]
