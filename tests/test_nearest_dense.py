"""Nearest neighbours where many rows share places or lie close: each place asks once and meets few points."""

import random

import pytest
from pyspark.sql import functions as F

from odresil.operators import nearest
from tests.test_nearest import km, moments


def met(monkeypatch):
    """Numbers of rows of the tables that the search writes."""
    sizes, real = {}, nearest.written

    def written(rows, name):
        out = real(rows, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(nearest, "written", written)
    return sizes


def test_rows_of_one_place_ask_once(spark, monkeypatch):
    sizes = met(monkeypatch)
    a = spark.range(3000).selectExpr("id", "cast(id % 2 as double) as lat", "0.5D as lon").unionByName(spark.sql("select 3000L as id, cast(null as double) as lat, 0D as lon"))
    p = spark.range(2000).selectExpr("id + 10 as pid", "cast(id % 2 as double) as plat", "0.4D as plon")
    got = {r.id: r.near for r in nearest.nearest_on_globe(a, p, [], "id", F.col("pid"), 2.0).collect()}
    assert len(got) == 3001 and {got[k].row for k in range(0, 3000, 2)} == {10} and {got[k].row for k in range(1, 3000, 2)} == {11} and got[3000] is None
    assert sizes["points"] == [2] and sizes["places"] == [3]


@pytest.mark.parametrize("side", ["globe", "time"])
def test_dense_points_start_in_finer_buckets(spark, monkeypatch, side):
    rng, levels = random.Random(2), []
    real = nearest.grown

    def grown(asked, points, by, place, point_place, cells, *rest):
        return real(asked, points, by, place, point_place, lambda level: levels.append(level) or cells(level), *rest)

    monkeypatch.setattr(nearest, "grown", grown)
    if side == "globe":
        asked = [(k, rng.uniform(10, 11), rng.uniform(20, 21)) for k in range(100)]
        points = [(k, rng.uniform(10, 11), rng.uniform(20, 21)) for k in range(1000)]
        a, p = spark.createDataFrame(asked, "id long, lat double, lon double"), spark.createDataFrame(points, "pid long, plat double, plon double")
        got = {r.id: r.near for r in nearest.nearest_on_globe(a, p, [], "id", F.col("pid"), 2.0).collect()}
        assert all((got[k].far, got[k].row) == pytest.approx(min((km((x, y), (u, v)), i) for i, u, v in points), abs=1e-6) for k, x, y in asked)
    else:
        asked, points = ([(k, 1, rng.randrange(4000)) for k in range(n)] for n in (100, 1000))
        a, p = spark.createDataFrame(moments(asked), "id long, g long, at timestamp"), spark.createDataFrame(moments(points), "pid long, g long, then timestamp")
        got = {r.id: tuple(r.near) for r in nearest.nearest_in_time(a, p, ["g"], "id", "at", "then", F.col("pid"), 4 * 3600).collect()}
        assert got == {k: min((abs(t - u), i) for i, _, u in points) for k, _, t in asked}
    assert min(levels) < -2
