"""Hops against dense matrix powers, windows against plain slicing, samples that no partitioning changes."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from odresil.operators import propagation, sampling


def test_hops_like_matrix_powers(spark):
    rng = np.random.default_rng(4)
    n, slots = 9, 5
    a = (rng.random((n, n)) < 0.35).astype(float)  # a[i, j]: an edge from i to j
    a[:, 2] = 0  # nothing leads to node 2
    x = rng.normal(size=(n, slots)) * (rng.random((n, slots)) < 0.7)
    pairs = [(i, j) for i in range(n) for j in range(n) if a[i, j]]
    edges = propagation.normalised(spark.createDataFrame(pairs + pairs[:4], "a long, b long"))
    degree = a.sum(0)
    inverse = np.divide(1, np.sqrt(degree), out=np.zeros(n), where=degree > 0)
    w = inverse[:, None] * a * inverse
    assert {(r.a, r.b): r.weight for r in edges.collect()} == pytest.approx({(i, j): w[i, j] for i, j in pairs})
    values = spark.createDataFrame([(i, t, float(x[i, t])) for i in range(n) for t in range(slots)], "node long, slot_idx int, value double")
    got = np.zeros((4, n, slots))
    for r in propagation.hops(values, edges, 3).collect():
        got[r.hop, r.node, r.slot_idx] = r.value
    for k in range(4):
        assert np.allclose(got[k], np.linalg.matrix_power(w.T, k) @ x)
    assert propagation.hops(values.limit(0), edges, 2).collect() == []
    assert {r.hop for r in propagation.hops(values, edges.limit(0), 2).collect()} == {0}


def test_windows_and_batches(spark):
    series = {k: [float(100 * k + t) for t in range(12)] for k in (1, 2)}
    df = spark.createDataFrame([(k, t, v) for k, s in series.items() for t, v in enumerate(s)], "node long, t int, v double").repartition(3)
    rows = propagation.windows(df, ["node"], "t", "v", [3, 1], 2, 2, 11).collect()
    assert {(r.node, r.t) for r in rows} == {(k, t) for k in (1, 2) for t in range(3, 11)}  # whole windows only
    for r in rows:
        s = series[r.node]
        assert r.inputs == [s[r.t - 3], s[r.t - 1]] and r.targets == s[r.t : r.t + 2]
    out = sorted(propagation.batches(propagation.windows(df, ["node"], "t", "v", [1], 1, 4, 8), "t", ["node"], 2).collect(), key=lambda r: r.t)
    assert [(r.batch, r.t) for r in out] == [(0, 4), (0, 5), (1, 6), (1, 7), (2, 8)]
    assert all([x.node for x in r.nodes] == [1, 2] and r.inputs == [[series[k][r.t - 1]] for k in (1, 2)] and r.targets == [[series[k][r.t]] for k in (1, 2)] for r in out)


def test_samples(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.8 else f"g{k % 5}", k, rng.random()) for k in range(3000)] + [("tiny", 1, 0.5), ("tiny", None, 0.1)]
    df = spark.createDataFrame(rows, "g string, k long, v double")
    take = lambda d: sorted(((r.g, r.place, r.k, r.v) for r in sampling.bottom_k(d, ["g"], ["g", "k"], 25).collect()), key=lambda r: r[:2])
    first = take(df.repartition(1))
    assert first == take(df.repartition(40).orderBy("v"))
    for g in {r[0] for r in rows}:
        members = sorted((hashlib.md5(f"{g},{'' if k is None else k}".encode()).hexdigest(), k, v) for name, k, v in rows if name == g)
        assert [(r[2], r[3]) for r in first if r[0] == g] == [(k, v) for _, k, v in members[:25]] or g == "tiny"
    assert len([r for r in first if r[0] == "tiny"]) == 2
    plan = sampling.bottom_k(df.repartition(4), ["g"], ["g", "k"], 25)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan  # tasks pass on no more than 25 rows of a group
    assert sampling.bottom_k(df.limit(0), ["g"], ["k"], 3).collect() == []
    assert df.select(sampling.hash_of("g", "k").alias("h")).where(F.length("h") != 32).count() == 0
