"""Factors in blocks against the one-task kernel; results that only grow; the whole decomposition of a unit."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from odresil.kernels import factor
from odresil.operators import factorise, flows, incremental
from odresil.plans import QUERIES, kernels


def pairs(sizes, slots=14, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for unit, n in sizes.items():
        x = rng.random((slots, 4)) @ rng.random((4, n)) + 0.05 * rng.random((slots, n))
        rows += [(unit, k // 7, k % 7, [float(v) for v in x[:, k]]) for k in range(n)]
    return pd.DataFrame(rows, columns=["unit", "origin", "dest", "series"])


def matrix(frame, unit):
    part = frame[frame.unit == unit].sort_values(["origin", "dest"])
    return part, np.array(part.series.tolist()).T


@pytest.mark.parametrize("l1", [0.0, 0.1])
def test_blocks_like_the_kernel(spark, l1):
    frame = pairs({"a": 40, "b": 9, "c": 23})
    df = spark.createDataFrame(frame, "unit string, origin long, dest long, series array<double>")
    w, h = factorise.nmf_blocks(df, 14, 3, l1=l1, sweeps=6, size=5, buckets=3)
    w = {r.unit: np.array(r.w).reshape(14, 3) for r in w.collect()}
    cells = factorise.loadings(h, 3).toPandas().pivot_table(index=["unit", "origin", "dest"], columns="component", values="value")
    for unit in ("a", "b", "c"):
        part, x = matrix(frame, unit)
        want_w, want_h = factor.nmf(x, 3, l1, sweeps=6)
        assert np.allclose(w[unit], want_w, atol=1e-6)
        assert np.allclose(cells.loc[unit].loc[list(zip(part.origin, part.dest))].to_numpy().T, want_h, atol=1e-6)


def test_units_stop_by_themselves(spark):
    """A unit that has settled keeps its factors while another goes on, and the kernel stops at the same round."""
    rng = np.random.default_rng(1)
    exact = np.outer(rng.random(14), rng.random(6))
    frame = pd.concat([pairs({"slow": 12}), pd.DataFrame([("quick", 0, k, exact[:, k].tolist()) for k in range(6)], columns=["unit", "origin", "dest", "series"])])
    df = spark.createDataFrame(frame, "unit string, origin long, dest long, series array<double>")
    w, _ = factorise.nmf_blocks(df, 14, 2, sweeps=8, tol=1e-2, size=4, buckets=2)
    for r in w.collect():
        want, _ = factor.nmf(matrix(frame, r.unit)[1], 2, sweeps=8, tol=1e-2)
        assert np.allclose(np.array(r.w).reshape(14, 2), want, atol=1e-6)


def test_rounds_move_no_blocks(spark):
    """The join of the matrix and H needs no exchange of either, and no step holds a unit's matrix."""
    df = spark.createDataFrame(pairs({"a": 30}), "unit string, origin long, dest long, series array<double>")
    rounds = factorise.Rounds(spark, 4)
    x = rounds.save(factorise.blocks(df, 5), "x")
    h = rounds.save(x.select("unit", "block", F.array(F.lit(1.0)).alias("h")), "h")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = x.join(h, ["unit", "block"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert max(len(r.keys) for r in x.collect()) < 30
    rounds.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("odresil_")]


def test_too_many_components(spark):
    df = spark.createDataFrame(pairs({"a": 2}), "unit string, origin long, dest long, series array<double>")
    with pytest.raises(ValueError, match="more components"):
        factorise.nmf_blocks(df, 14, 3)


def test_block_query_like_the_kernel_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {(r.unit, r.component): (r.w_sum, r.h_sum) for r in QUERIES["nmf_block_factors"](spark, sf).collect()}
    x = kernels.matrices(spark, sf).toPandas()
    for unit in x.unit.unique():
        _, m = kernels.dense(x[x.unit == unit])
        w, h = factor.nmf(m, 3, l1=0.1, sweeps=kernels.BLOCK_SWEEPS)
        for j in range(3):
            assert got[unit, j] == pytest.approx((w[:, j].sum(), h[j].sum()), rel=1e-5)


def test_a_second_run_fits_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kernels, "RANKS", (1, 2))
    df = spark.createDataFrame(pairs({1: 8, 2: 6}), "unit long, origin long, dest long, series array<double>")
    path = str(tmp_path / "errors")
    first, n = kernels.rank_errors(df, path)
    rows = sorted(map(tuple, first.collect()))
    assert n == 20 == len(rows)
    again, n = kernels.rank_errors(df.repartition(5), path)
    assert n == 0 and sorted(map(tuple, again.collect())) == rows
    monkeypatch.setattr(kernels, "RANKS", (1, 2, 3))
    _, n = kernels.rank_errors(df, path)
    assert n == 10  # the new rank alone
    changed = df.withColumn("series", F.when(F.col("unit") == 2, F.transform("series", lambda v: v + 1)).otherwise(F.col("series")))
    both, n = kernels.rank_errors(changed, path)
    assert n == 15 and both.count() == 30  # the changed unit alone, and no row of its old matrix
    for r in first.where("unit = 1 and rep = 0").collect():
        assert r.error == pytest.approx(factor.masked_error(matrix(pairs({1: 8, 2: 6}), 1)[1], r.k, 42, l1=0.1))


def test_digests(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1)], "g string, v int")
    take = lambda rows, *settings: {r.g: r.digest for r in incremental.digest_of(rows, ["g"], ["v"], *settings).collect()}
    first = take(df, 1)
    assert first == take(df.orderBy(F.desc("v")), 1) and first["a"] != first["b"]
    assert take(df, 2)["a"] != first["a"] and take(df.unionAll(df), 1)["a"] != first["a"]
    assert take(df.where("v = 2 or g = 'b'"), 1)["b"] == first["b"]


def test_bands(spark):
    table = spark.createDataFrame([("u", 1, 1.3, 0.1), ("u", 2, 1.0, 0.2), ("u", 3, 1.0, 0.5), ("u", 4, 1.15, 0.1), ("u", 5, 1.39, 0.1), ("v", 1, float("nan"), None), ("v", 2, 0.5, None)], "unit string, k int, mean double, sd double")
    got = {r.unit: r for r in incremental.bands(table, ["unit"], n=4).collect()}
    u, v = got["u"], got["v"]
    assert (u.best, u.lo_1se, u.hi_1se, u.lo_2se, u.hi_2se, u.lo_2sd, u.hi_2sd) == (2, 2, 3, 2, 4, 1, 5)
    assert (v.best, v.lo_1se, v.hi_2sd) == (2, 2, 2)


def test_positions_outside_the_spine_raise(spark):
    df = spark.createDataFrame([(0, "a", "b", 1.0), (400, "a", "b", 5.0)], "slot_idx int, origin string, dest string, flow double")
    for build in (lambda d: flows.dense_totals(d, [], "slot_idx", 360), lambda d: flows.packed_rows(d, 360)):
        with pytest.raises(Exception, match="outside 0..359"):
            build(df).collect()
        with pytest.raises(Exception, match="outside 0..359"):
            build(df.withColumn("slot_idx", -F.col("slot_idx"))).collect()
    assert flows.dense_totals(df, [], "slot_idx", 401).agg(F.sum("flow")).first()[0] == 6.0


def test_decomposition(spark):
    out = QUERIES["unit_decomposition"](spark, "/root/testdata/sf0.001").toPandas()
    assert len(out) and (out.weight >= 0).all() and out.top_flow.dropna().between(0, 1).all()
    for _, g in out.groupby("unit"):
        kept = g[g.kept].sort_values("component")
        assert kept.new_component.tolist() == list(range(len(kept))) and g[~g.kept].new_component.isna().all()
        assert ((g.share_k < 0.5) & (g.top_flow >= 0.2) == ~g.kept).all()
