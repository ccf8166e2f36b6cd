"""The small relational steps: what raises, ties and missing values."""

import pytest
from pyspark.sql import functions as F

from odresil.operators import features, flows, stats, tables


def test_split_check():
    assert tables.split_check({1, 2}, {3}, {1, 2, 3}) == "split" and tables.split_check({1, 2}, {1, 2}, {1, 2}) == "pooled"
    for train, test in ((set(), {1}), ({1}, set()), ({1, 9}, {2}), ({1, 2}, {2, 3})):
        with pytest.raises(ValueError):
            tables.split_check(train, test, {1, 2, 3})


def test_constants_of_every_unit(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "unit string, x int")
    known = spark.createDataFrame([("a", 5), ("b", 6), ("c", 7)], "unit string, gdp int")
    assert sorted(map(tuple, tables.with_constants(rows, known, "unit").collect())) == [("a", 1, 5), ("b", 2, 6)]
    with pytest.raises(Exception, match="no constants of unit b"):
        tables.with_constants(rows, known.where("unit = 'a'"), "unit").collect()


def test_orders_and_quantiles(spark):
    df = spark.createDataFrame([("u", k, v) for k, v in enumerate([2.0, None, 5.0, 2.0])], "unit string, k int, v double")
    got = tables.importance_order(df, ["unit"], "v", ["k"]).collect()
    assert {r.k: r.place for r in got} == {2: 1, 0: 2, 3: 3, 1: 4}
    q = df.where("v is not null").groupBy("unit").agg(F.collect_list("v").alias("a")).select(*[tables.step_quantile(F.col("a"), p) for p in (0.0, 0.34, 0.67, 0.99)]).first()
    assert tuple(q) == (2.0, 2.0, 5.0, 5.0)
    cells = df.where("v is not null").select("k", tables.quantile_cell("v", ["unit"], ["k"], [0.0, 0.5, 1.0]).alias("c")).collect()
    assert {r.k: r.c for r in cells} == {0: 0, 3: 0, 2: 1}
    assert tables.median_fold(df, "v", "k").first().k == 3 and tables.median_fold(df.where("v > 9"), "v", "k").count() == 0
    assert tuple(tables.correction_units(df, "v", "k").first()) == (0, 0, 2)


def test_frame_hash(spark):
    rows = [("a", 1, 2.0), ("a", 2, None), ("b", 1, 2.0)]
    h = lambda r: {x.unit: x.digest for x in tables.frame_hash(spark.createDataFrame(r, "unit string, k int, v double"), ["k", "v"], "unit").collect()}
    assert h(rows) == h(rows[::-1]) and h(rows)["a"] != h([*rows, rows[0]])["a"] and len(set(h(rows).values())) == 2


def test_scaling_and_scores(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([4.0, 4.0, 4.0, 9.0])], "slot int, v double").withColumn("part", tables.day_split(F.col("slot"), 1, 4, 0.75))
    assert [r.part for r in df.orderBy("slot").collect()] == ["train"] * 3 + ["test"]
    out = tables.scaled(df, tables.train_scaling(df, "v", F.col("part") == "train"), "v").orderBy("slot").collect()
    assert [r.scaled for r in out] == [0, 0, 0, 5]
    pairs = spark.createDataFrame([(1, 1.0, 2.0), (1, 3.0, 3.0), (2, 5.0, 4.0), (2, None, 4.0)], "step int, t double, g double")
    got = {r.step: r for r in tables.step_scores(pairs, "step", "t", "g").collect()}
    assert (got[1].n, got[1].mse, got[1].mae, got[1].r2) == (2, 0.5, 0.5, 0.5) and got[2].r2 is None and got[2].n == 1


def test_strict_scan(spark):
    df = spark.createDataFrame([(s, "a", "b", 1.0) for s in range(36)], "slot_idx int, origin string, dest string, flow double")
    meta = lambda n, h: spark.createDataFrame([(n, h)], "n_slots int, interval_hours int")
    assert flows.head_days(df, meta(36, 2), 2, 12).count() == 24
    with pytest.raises(ValueError):
        flows.head_days(df, meta(36, 2), None, 12)
    for n, h, days in ((36, None, 2), (36, 3, 2), (35, 2, 2), (36, 2, 4)):
        with pytest.raises(Exception, match="series"):
            flows.head_days(df, meta(n, h), days, 12).collect()
    assert flows.least_activity(30, 0.5) == 120.0


def test_gate(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 3.0), ("a", None, 4.0), ("b", 1.0, 1.0), ("b", 2.0, 1.0), ("c", 1.0, float("nan")), ("c", 2.0, 5.0)]
    df = spark.createDataFrame(rows, "unit string, x double, y double")
    assert {r.unit for r in features.usable(df, ["unit"], ["x"], "y", 2).collect()} == {"a"}
    assert features.usable(df, ["unit"], ["x"], "y", 3).count() == 0


def test_correlation(spark):
    df = spark.createDataFrame([("a", 1.0, 3.0), ("a", 2.0, 2.0), ("a", 9.0, None), ("a", 4.0, 0.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 5.0), ("c", 1.0, 1.0)], "k string, x double, y double")
    got = {r.k: (r.n, r.rho, r.p) for r in stats.with_p_values(stats.correlation(df, ["k"], "x", "y")).collect()}
    assert got["a"] == (3, pytest.approx(-1), 0.0) and got["b"] == (3, None, None) and got["c"] == (1, None, None)
    with pytest.raises(ValueError):
        stats.correlation(df, ["k"], "x", "y", "kendall")


def test_neighbours_by_blocks_beyond_a_bound(spark, monkeypatch):
    rows = [(k, [float(k % 3), 1.0 + k % 5, 0.5], float(k)) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y double")
    paired = {r.id: r.pred for r in stats.cosine_knn(df, df.select("id", "v"), True).collect()}
    monkeypatch.setattr(stats, "PAIRED_ROWS", 10)
    blocks = {r.id: r.pred for r in stats.cosine_knn(df, df.select("id", "v"), True).collect()}
    assert blocks == pytest.approx(paired)
