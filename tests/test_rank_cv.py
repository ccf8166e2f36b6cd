"""Rank cross-validation covers the whole grid of ranks that a unit's matrix allows."""

import inspect

import numpy as np

from odresil.kernels import factor
from odresil.plans.kernels import RANKS, REPEATS, matrices, rank_grid

SF = "/root/testdata/sf0.001"


def test_grid(spark):
    assert REPEATS == 5 and RANKS == (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 15, 18, 21, 25, 30, 35, 40)
    x = matrices(spark, SF)
    periods = len(x.first().series)
    bound = {r["unit"]: min(periods, r["count"]) for r in x.groupBy("unit").count().collect()}
    rows = rank_grid(x).select("unit", "k", "rep").distinct().collect()
    assert sorted((r.unit, r.k, r.rep) for r in rows) == sorted((u, k, i) for u, b in bound.items() for k in RANKS if k <= b for i in range(5))


def test_rounds():
    p = inspect.signature(factor.masked_error).parameters
    assert p["rounds"].default == 12 and p["sweeps"].default == 120
    x = np.random.default_rng(3).random((30, 6)) @ np.random.default_rng(4).random((6, 24))
    assert factor.masked_error(x, 6, 42, l1=0.1) < factor.masked_error(x, 6, 42, rounds=3)
    assert np.isnan(factor.masked_error(x, 2, 1, share=0.0))
