"""Permutation tests, adjustment, places in a global order, and the factorisation's sweeps."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from odresil.operators import ordering, permutation, stats
from odresil.plans import QUERIES
from odresil.plans.kernels import SWEEPS

SF = "/root/testdata/sf0.001"
COLUMNS = ["a", "b", "c"]


def scores(sizes, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for unit, n in sizes.items():
        x = rng.normal(size=(n, 3))
        x[:, 1] += 0.6 * x[:, 0]
        x = (x - x.mean(0)) / x.std(0)
        rows += [(unit, k, *map(float, r)) for k, r in enumerate(x)]
    return pd.DataFrame(rows, columns=["unit", "item", *COLUMNS])


def exhaustive(frame, a, b):
    """The share of all arrangements within units that reach the observed mean product."""
    parts = [g for _, g in frame.groupby("unit")]
    seen = abs((frame[a] * frame[b]).mean())
    sums = [0.0]
    for g in parts:
        own = [float(np.dot(g[a], p)) for p in itertools.permutations(g[b])]
        sums = [s + o for s in sums for o in own]
    return np.mean(np.abs(np.array(sums) / len(frame)) >= seen - 1e-12)


def test_like_all_arrangements(spark):
    frame = scores({"u": 4, "v": 5})
    rows = spark.createDataFrame(frame).withColumn("panel", F.lit("all"))
    got = permutation.permutation_test(rows, "panel", "unit", "item", COLUMNS).collect()
    assert {(r.a, r.b) for r in got} == {("a", "b"), ("a", "c"), ("b", "c")} and all(r.n == 9 for r in got)
    for r in got:
        assert r.rho == pytest.approx((frame[r.a] * frame[r.b]).mean())
        want = exhaustive(frame, r.a, r.b)
        assert abs(r.p - want) <= 4 * np.sqrt(want * (1 - want) / permutation.DRAWS) + 2e-4
        assert abs(r.p * 10_001 - round(r.p * 10_001)) < 1e-6


def test_draws_do_not_depend_on_the_cluster(spark):
    frame = scores({k: 3 + k for k in range(6)}, 3)
    rows = spark.createDataFrame(frame).withColumn("panel", F.explode(F.array(F.lit("all"), F.concat(F.lit("p"), F.col("unit") % 2))))
    table = lambda df, **k: sorted((r.panel, r.a, r.b, r.p) for r in permutation.permutation_test(df, "panel", "unit", "item", COLUMNS, 1100, **k).collect())
    first = table(rows.repartition(1))
    assert first == table(rows.repartition(11).orderBy("c")) and len(first) == 9
    assert first != table(rows, seed=5)


def test_missing_values_and_small_panels(spark):
    frame = scores({"u": 4, "v": 5}).assign(panel="x")
    small = frame.head(2).assign(panel="small")
    rows = spark.createDataFrame(pd.concat([frame, small]))
    rows = rows.withColumn("c", F.when((F.col("panel") == "x") & (F.col("unit") == "v"), None).otherwise(F.col("c")))
    got = {(r.panel, r.a, r.b): (r.rho, r.p) for r in permutation.permutation_test(rows, "panel", "unit", "item", COLUMNS, 100).collect()}
    assert got["x", "a", "b"][1] is not None and got["x", "a", "c"] == (None, None) and got["small", "a", "b"] == (None, None)
    assert permutation.permutation_test(rows.limit(0), "panel", "unit", "item", COLUMNS, 100).collect() == []


def test_adjusted_values(spark):
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.random(200) ** 3, np.full(150, 0.25), [1.0, 0.0]])
    df = spark.createDataFrame([(int(k), float(x)) for k, x in enumerate(p)] + [(-1, None), (-2, float("nan"))], "id long, p double").repartition(7)
    order = np.argsort(p, kind="stable")
    want = np.empty(len(p))
    want[order] = np.minimum(np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1], 1)
    got = {r.id: r.q for r in stats.bh_adjust(df, "p").collect()}
    assert set(got) == set(range(len(p))) and np.allclose([got[k] for k in range(len(p))], want)
    assert stats.bh_adjust(df.limit(0), "p").collect() == []


def test_places_in_order(spark):
    df = spark.createDataFrame([(k % 13, str(k % 3), k) for k in range(500)] + [(1, None, -1)], "a long, b string, k long").repartition(6)
    rows = ordering.numbered(df, ["a", "b"], "place").collect()
    assert sorted(r.place for r in rows) == list(range(501)) and len({r.k for r in rows}) == 501
    keys = [(r.a, r.b is not None, r.b or "") for r in sorted(rows, key=lambda r: r.place)]
    assert keys == sorted(keys)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together again
    try:
        rows, starts = ordering.ranged(df.withColumn("a", F.lit(1)), "a")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(starts) > 1 and rows.count() == 501  # a key of all rows still has several ranges
    assert "SinglePartition" not in ordering.numbered(df, ["a"], "n")._jdf.queryExecution().toString()


def test_p_is_a_multiple_of_its_draws(spark):
    r = QUERIES["permutation_p"](spark, "/root/testdata/sf0.01").first()
    assert 0 < r.p <= 1 and abs(r.p * 10_001 - round(r.p * 10_001)) < 1e-6 and -1 <= r.observed <= 1
    assert QUERIES["permutation_p"](spark, SF).count() <= 1


def test_sweeps(spark):
    assert SWEEPS == 5_000 and QUERIES["nmf_cd"](spark, SF).count() > 0
