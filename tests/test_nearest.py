"""Nearest neighbours by growing buckets against all pairs: poles, the date line, ties, empty sides, sparse keys."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from odresil.operators import nearest
from odresil.plans import QUERIES


def km(a, b):
    (x, y), (u, v) = ((math.radians(p), math.radians(q)) for p, q in (a, b))
    h = math.sin((u - x) / 2) ** 2 + math.cos(x) * math.cos(u) * math.sin((v - y) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1, h)))


@pytest.mark.parametrize("degrees", [0.7, 2.0, 45.0, 400.0])
def test_globe_like_all_pairs(spark, degrees):
    rng = random.Random(7)
    asked = [(k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(60)] + [(100, 89.9, 10.0), (101, -89.9, -170.0), (102, 0.0, 179.95), (103, 0.0, -179.95), (104, 45.0, 0.0), (105, 90.0, 0.0)]
    points = [(k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(40)] + [(50, 89.8, -170.0), (51, 0.1, -179.9), (52, 45.0, 1.0), (53, 45.0, -1.0), (53, 45.0, -1.0)]
    a = spark.createDataFrame(asked, "id long, lat double, lon double")
    p = spark.createDataFrame(points, "pid long, plat double, plon double")
    got = {r.id: (r.near.far, r.near.row) for r in nearest.nearest_on_globe(a, p, [], "id", F.col("pid"), degrees).collect()}
    assert set(got) == {r[0] for r in asked}
    for k, lat, lon in asked:
        far = [(km((lat, lon), (u, v)), i) for i, u, v in points]
        assert got[k][0] == pytest.approx(min(far)[0], abs=1e-6)
        assert km((lat, lon), next((u, v) for i, u, v in points if i == got[k][1])) == pytest.approx(min(far)[0], abs=1e-6)
    assert got[104][1] == 52  # of equally near ones the least


def moments(rows):
    start = datetime.datetime(2024, 1, 1)
    return [(*r[:-1], start + datetime.timedelta(seconds=r[-1])) for r in rows]


def test_time_like_all_pairs(spark):
    rng = random.Random(3)
    asked = [(k, rng.randrange(4), rng.randrange(10**6)) for k in range(150)] + [(900, 77, 5)]
    points = [(k, rng.randrange(3), rng.randrange(10**6)) for k in range(40)] + [(60, 3, 0), (61, 3, 10**6), (62, 3, 10**6)]
    a = spark.createDataFrame(moments(asked), "id long, g long, at timestamp")
    p = spark.createDataFrame(moments(points), "pid long, g long, then timestamp")
    got = {r.id: r.near for r in nearest.nearest_in_time(a, p, ["g"], "id", "at", "then", F.col("pid"), 600).collect()}
    for k, g, t in asked:
        far = [(abs(t - u), i) for i, h, u in points if h == g]
        assert (got[k] is None) if not far else (tuple(got[k]) == min(far))
    assert len(got) == len(asked) and got[900] is None


def test_empty_sides_and_plan(spark):
    a = spark.createDataFrame(moments([(1, 1, 5)]), "id long, g long, at timestamp")
    p = spark.createDataFrame(moments([(1, 1, 9)]), "pid long, g long, then timestamp")
    run = lambda x, y: nearest.nearest_in_time(x, y, ["g"], "id", "at", "then", F.col("pid")).collect()
    assert run(a.limit(0), p) == [] and [r.near for r in run(a, p.limit(0))] == [None]
    plan = nearest.nearest_in_time(a, p, ["g"], "id", "at", "then", F.col("pid"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_queries_ask_for_every_row(spark):
    sf = "/root/testdata/sf0.001"
    assert QUERIES["nearest_supplier"](spark, sf).count() == spark.read.parquet(f"{sf}/customer.parquet").count()
