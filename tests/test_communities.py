"""Communities of planted graphs, invariants under relabelling, the sweep's table and its rule."""

import numpy as np
import pandas as pd

from odresil.kernels import graph
from odresil.operators import communities


def planted(sizes, inside=1.0, between=0.05, seed=0):
    rng = np.random.default_rng(seed)
    group = np.repeat(np.arange(len(sizes)), sizes)
    a = np.where(group[:, None] == group, inside, between) * rng.uniform(0.8, 1.2, (len(group),) * 2)
    a = (a + a.T) / 2
    np.fill_diagonal(a, 0)
    return a, group


def same(a, b):
    return np.array_equal(a[:, None] == a, np.asarray(b)[:, None] == b)


def test_planted_groups_are_found():
    for sizes in ((4, 4, 5), (3, 3, 3, 3, 3), (6, 7)):
        a, group = planted(sizes)
        for seed in range(10):
            assert same(graph.louvain(a, 1.0, seed), group)


def test_relabelling_changes_names_only():
    a, group = planted((4, 5, 4), seed=3)
    turn = np.random.default_rng(1).permutation(len(a))
    assert same(graph.louvain(a[np.ix_(turn, turn)], 1.0, 0), group[turn])
    label = graph.louvain(a, 1.0, 0)
    assert list(dict.fromkeys(label.tolist())) == list(range(label.max() + 1))  # in order of first members


def test_moves_never_lose_modularity():
    rng = np.random.default_rng(5)
    for seed in range(20):
        a = np.triu(rng.random((9, 9)) * (rng.random((9, 9)) < 0.4), 1)
        a = a + a.T
        for gamma in (0.5, 1.0, 2.0):
            found = graph.louvain(a, gamma, seed)
            assert graph.modularity(a, found, gamma) >= graph.modularity(a, np.arange(9), gamma) - 1e-12


def test_edgeless_and_modularity_by_hand():
    assert graph.louvain(np.zeros((3, 3)), 1.0, 0).tolist() == [0, 1, 2] and graph.modularity(np.zeros((2, 2)), np.zeros(2), 1.0) == 0
    a = np.array([[0, 1, 0, 0], [1, 0, 0, 0], [0, 0, 0, 1], [0, 0, 1, 0]], float)
    assert graph.modularity(a, np.array([0, 0, 1, 1]), 1.0) == 0.5 and graph.modularity(a, np.zeros(4), 1.0) == 0


def test_affinity(spark):
    rows = spark.createDataFrame([(1, 2, 0.5), (2, 1, -0.3), (1, 1, 9.0), (1, 3, None), (3, 1, float("nan")), (2, 3, 1.0), (3, 2, 0.5)], "s long, t long, w double")
    assert sorted(tuple(r) for r in communities.affinity(rows, "s", "t", "w").collect()) == [(1, 2, 0.25), (1, 3, 0.0), (2, 3, 0.75)]


def test_sweep_over_a_planted_graph(spark):
    a, group = planted((4, 4, 4), between=0.02)
    edges = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(12) for j in range(i + 1, 12)], "a long, b long, weight double")
    units = spark.createDataFrame([(i,) for i in range(13)], "unit long")  # one without edges
    found = communities.partitions(units, edges, (0.05, 1.0, 30.0), 5)
    assert found.count() == 3 * 5 * 13
    table = {r.gamma: r for r in communities.sweep(found).collect()}
    assert table[1.0].blocks == 4 and table[1.0].sizes == [4, 4, 4, 1] and table[1.0].distinct == 1 and table[1.0].agreement == 1
    assert table[0.05].blocks == 2 and table[30.0].blocks == 13
    assert communities.chosen(communities.sweep(found)).first().gamma == 1.0


def test_rule_without_a_gap(spark):
    table = lambda rows: spark.createDataFrame(rows, "gamma double, blocks int")
    assert communities.chosen(table([(0.5, 1), (1.0, 6)])).first().gamma == communities.FALLBACK
    assert communities.chosen(table([(0.5, 1), (1.0, 2), (1.1, 3), (1.2, 4), (2.0, 7)])).first().gamma == 1.1
    assert pd.isna(communities.chosen(table([])).first().gamma) is False
