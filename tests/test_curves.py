"""Hand-computed curves and leak guards."""

import pytest
from pyspark.sql import functions as F

from odresil.config import Windows
from odresil.operators import curves as op
from odresil.operators import flows

#: Three slots a week would do; days start on a Thursday, so the weekend falls on days 2, 3, 9, 10, ...
W = Windows(normal=9, buffer=4, disaster=6, slots=1, first_slot=0, last_slot=0, first_weekday=3)
NORMAL = [30, 34, 12, 8, 32, 28, 36, 31, 33]  # weekdays average 32, the weekend 10


def daily(spark, buffer, disaster, base=NORMAL):
    return spark.createDataFrame([("a", d, float(v)) for d, v in enumerate([*base, *buffer, *disaster])], "component string, day_idx int, flow double")


def curve(spark, df):
    return [r.r for r in op.relative_curve(df, ["component"], W).orderBy("day").collect()]


def test_ratio_and_smoothing(spark):
    # days 13 to 18: a Wednesday, Thursday, Friday, Saturday, Sunday, Monday
    df = daily(spark, [77, 5, 0, 123], [8, 16, 48, 2, 15, 40])
    assert curve(spark, df) == pytest.approx([0.25, 0.5, 1.5, 0.2, 1.5, 1.25])
    ratio = op.relative_curve(df, ["component"], W)
    smooth = op.smooth_ratio_of_sums(ratio, ["component"]).orderBy("day").collect()
    assert [r.r for r in smooth] == pytest.approx([24 / 64, 72 / 96, 66 / 74, 65 / 52, 57 / 52, 55 / 42])
    means = op.smooth_mean_of_ratios(ratio, ["component"]).orderBy("day").collect()
    assert [r.r for r in means] == pytest.approx([0.375, 0.75, 2.2 / 3, 3.2 / 3, 2.95 / 3, 1.375])
    even = op.smooth_ratio_of_sums(ratio, ["component"], 2).orderBy("day").collect()
    assert [r.r for r in even] == pytest.approx([8 / 32, 24 / 64, 64 / 64, 50 / 42, 17 / 20, 55 / 42])


def test_buffer_does_not_matter(spark):
    a, b = (curve(spark, daily(spark, [v] * 4, [11] * 6)) for v in (3, 4 * 10**5))
    assert a == b


def test_zero_baseline(spark):
    assert curve(spark, daily(spark, [2] * 4, [6] * 6, [0] * 9)) == [None] * 6
    quiet = [v if d % 7 not in (2, 3) else 0 for d, v in enumerate(NORMAL)]  # no weekend activity
    rows = op.relative_curve(daily(spark, [2] * 4, [8, 16, 48, 2, 15, 40], quiet), ["component"], W).withColumn("base", F.coalesce("base", F.lit(0.0)))
    assert [r.r for r in rows.orderBy("day").collect()] == pytest.approx([0.25, 0.5, 1.5, None, None, 1.25])
    mixed = [r.r for r in op.smooth_ratio_of_sums(rows, ["component"], 2).orderBy("day").collect()]
    assert mixed == pytest.approx([8 / 32, 24 / 64, 64 / 64, 50 / 32, None, 55 / 32])


def two_components(spark):
    """Two components and a city whose flow is not their sum."""
    rows = [(c, d, float(17 + 2 * d + k * 9 + (d * (k + 2)) % 7)) for k, c in enumerate("ab") for d in range(19)]
    df = spark.createDataFrame(rows, "component string, day_idx int, flow double")
    city = spark.createDataFrame([(d, 80.0 + 3 * d + d % 4) for d in range(19)], "day_idx int, flow double")
    return df.withColumn("h", F.when(F.col("component") == "a", 0.4).otherwise(1.3)), city


@pytest.mark.parametrize("smoothing", op.SMOOTHINGS)
def test_coherence_identity(spark, smoothing):
    df, city = two_components(spark)
    base = op.city_baselines(city, [], W)
    raw = op.relative_curve(df, ["component", "h"], W)
    smooth = op.smooth_ratio_of_sums if smoothing == "ratio_of_sums" else op.smooth_mean_of_ratios
    out = op.coherent(smooth(raw, ["component", "h"]), ["component"], [], base, smoothing=smoothing)
    got = {r.day: r.r_city for r in op.city_curve(out, [], base).collect()}
    activity = {r.day: r.a for r in raw.groupBy("day").agg(F.sum(F.expr("activity * h")).alias("a")).collect()}
    b = {r.day: r.city_base for r in base.collect()}
    for d in activity:
        near = [x for x in (d - 1, d, d + 1) if x in activity]
        sums = sum(activity[x] for x in near) / sum(b[x] for x in near)
        want = sums if smoothing == "ratio_of_sums" else sum(activity[x] / b[x] for x in near) / len(near)
        assert got[d] == pytest.approx(want, rel=1e-10)


def test_coherence_ignores_the_citys_later_flow_and_raises_where_undefined(spark):
    df, city = two_components(spark)
    one, two = (op.city_baselines(c, [], W) for c in (city, city.withColumn("flow", F.when(F.col("day_idx") < 9, F.col("flow")).otherwise(1e6))))
    assert sorted(one.collect()) == sorted(two.collect())
    raw = op.relative_curve(df, ["component", "h"], W)
    still = raw.withColumns({"activity": F.lit(0.0), "r": F.lit(0.0)})
    assert {r.r for r in op.coherent(still, ["component"], [], one).collect()} == {0.0}
    for bad in (op.coherent(raw.withColumn("r", F.lit(0.0)), ["component"], [], one), op.coherent(raw, ["component"], [], one.withColumn("city_base", F.lit(0.0)))):
        with pytest.raises(Exception, match="undefined"):
            bad.collect()
    with pytest.raises(ValueError):
        op.coherent(raw, ["component"], [], one, smoothing="median")


def test_metrics(spark):
    df = spark.createDataFrame([(0, 1.0, 9.0), (1, 0.0, 1.0), (2, 4.0, 2.0), (3, None, 1.0), (4, float("nan"), 1.0)], "day int, t double, g double")
    r = op.curve_metrics(df.where("day >= 1"), [], "t", "g").first()
    assert (r.n, r.mae, r.mape) == (2, 1.5, 0.5) and r.r2 == pytest.approx(1 - 5 / 8)
    assert op.curve_metrics(df.where("day > 9"), [], "t", "g").first().mae is None


def test_comparison(spark):
    df = spark.createDataFrame([(12.0, 10.0, 15.0, 8.0), (3.0, 0.0, 1.0, -1.0)], "a double, b double, u double, l double")
    one, two = op.comparison(df, "a", "b", "u", "l").collect()
    assert (one.pct_change, one.pct_upper, one.pct_lower) == pytest.approx((0.2, 0.5, -0.2))
    assert (two.pct_change, two.pct_upper, two.pct_lower) == (None, -4.0, 2.0)


def test_activity_filter_threshold_and_self_loop(spark):
    df = spark.createDataFrame([(0, "a", "a", 5.0), (0, "a", "b", 1.0), (1, "b", "c", 2.0), (1, "c", "c", 0.0)], "slot_idx int, origin string, dest string, flow double")
    kept = flows.active_pairs(df, 3.0).collect()
    assert sorted((r.origin, r.dest) for r in kept) == [("a", "a"), ("a", "b")]  # b has 3 exactly, c has 2; a's loop counts twice
