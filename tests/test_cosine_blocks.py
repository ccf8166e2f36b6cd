"""Cosine neighbours over all vectors against brute force, in one block and in several."""

import numpy as np
import pytest

from odresil.operators import stats
from odresil.plans import QUERIES
from odresil.plans.stats import vectors

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("loo", [False, True])
def test_all_vectors(spark, loo):
    rows = vectors(spark, SF).collect()
    x, y, ids = np.array([r.v for r in rows], float), np.array([r.y for r in rows]), [r.id for r in rows]
    assert max(ids) >= 50
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = np.maximum(x @ x.T, 0)
    if loo:
        np.fill_diagonal(w, 0)
    want = dict(zip(ids, w @ y / w.sum(1)))
    got = {r.id: r.pred for r in QUERIES["cosine_knn_loo_all" if loo else "cosine_knn_all"](spark, SF).collect()}
    assert got == pytest.approx(want, abs=2e-6)
    v = vectors(spark, SF)
    assert {r.id: r.pred for r in stats.cosine_knn_blocks(v, v, loo, size=40).collect()} == pytest.approx(want, abs=2e-6)


@pytest.mark.parametrize("loo", [False, True])
def test_both_forms_treat_missing_values_alike(spark, loo, monkeypatch):
    """Rows without a label or a vector teach nothing in either form; a test row without a vector gets the mean."""
    rows = [(1, [1.0, 0.0], 1.0), (2, [0.6, 0.8], 0.0), (3, [0.0, 1.0], None), (4, None, 5.0), (5, [1.0, 1.0], 3.0)]
    v = spark.createDataFrame(rows, "id long, v array<double>, y double")
    paired = {r.id: r.pred for r in stats.cosine_knn(v, v, loo).collect()}
    blocks = {r.id: r.pred for r in stats.cosine_knn_blocks(v, v, loo, size=2).collect()}
    monkeypatch.setattr(stats, "PAIRED_ROWS", 1)
    switched = {r.id: r.pred for r in stats.cosine_knn(v, v, loo).collect()}
    assert paired == pytest.approx(blocks) and paired == pytest.approx(switched)
    assert paired[4] == pytest.approx(4 / 3) and set(paired) == {1, 2, 3, 4, 5}
