"""Wind profile, exposure and impact periods by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from odresil.operators import storm
from odresil.operators.impact import impact_period


@pytest.mark.parametrize(
    "km,vmax,r34,r50,r64,wind",
    [
        (50, 100, 200, 150, 100, 82),
        (50, 100, 200, 150, 0, 100 - 50 * 50 / 150),
        (50, 100, 200, 0, 0, 100 - 66 * 50 / 200),
        (50, 100, 200, None, None, 0),
        (125, 100, 200, 150, 100, 57),
        (175, 100, 200, 150, 100, 42),
        (400, 100, 200, 150, 100, 34 * 0.5**0.6),
        (400, 100, None, 150, 100, 0),
        (10, 60, 0, 0, 0, 0),
        (150, 90, 200, 0, 100, 64 - 30 * 150 / 200),
    ],
)
def test_wind_profile(spark, km, vmax, r34, r50, r64, wind):
    df = spark.createDataFrame([(float(km), float(vmax), *(None if r is None else float(r) for r in (r34, r50, r64)))], "km double, v double, a double, b double, c double")
    got = df.select(storm.rankine_wind(*(F.col(c) for c in ("km", "v", "a", "b", "c")))).first()[0]
    assert got == pytest.approx(wind)


TRACK = "basin_id string, time timestamp_ntz, lat double, lon double, wind_kt double, r34 array<double>, r50 array<double>, r64 array<double>"


def track(spark, *points):
    start = datetime.datetime(2024, 5, 1)
    rows = [(b, start + datetime.timedelta(hours=h), lat, lon, 70.0, [100.0, 20.0, 20.0, 20.0], [0.0] * 4, [None] * 4) for b, h, lat, lon in points]
    return spark.createDataFrame(rows, TRACK)


def test_exposure_sees_the_quadrant_from_the_interpolated_centre(spark):
    # the storm passes north of the place between two records, both south of it
    t = track(spark, ("X", 0, 10.0, 20.0), ("X", 6, 12.0, 20.0))
    place = spark.createDataFrame([(1, "X", 11.0, 20.2), (2, "Y", 0.0, 0.0)], "place int, basin_id string, plat double, plon double")
    both = t.unionAll(track(spark, ("Y", 0, 0.1, 0.0), ("Y", 6, 3.0, 0.0)))
    rows = {r.place: r for r in storm.exposure_band(storm.nearest_record(storm.closest_approach(place, both), both)).collect()}
    assert rows[1].quadrant == 0 and rows[1].band == 34 and rows[1].km == pytest.approx(21.8, abs=0.2)
    assert rows[2].quadrant == 1 and rows[2].band == 34  # on the meridian: the east side


def test_window_falls_back_to_the_whole_track(spark):
    t = track(spark, ("X", 0, 10.0, 20.0), ("X", 6, 12.0, 20.0), ("X", 12, 14.0, 20.0), ("Y", 0, 0.0, 0.0), ("Y", 6, 1.0, 0.0))
    at = lambda h: datetime.datetime(2024, 5, 1) + datetime.timedelta(hours=h)
    w = spark.createDataFrame([("X", at(5), at(13)), ("Y", at(5), at(13))], "basin_id string, start timestamp_ntz, end timestamp_ntz")
    kept = storm.windowed(t, w).groupBy("basin_id").count().collect()
    assert {r[0]: r[1] for r in kept} == {"X": 2, "Y": 2}


def test_landfall_day_falls_back_to_the_nearest_record(spark):
    t = track(spark, ("X", 0, 10.0, 20.0), ("X", 6, 10.5, 20.0))
    points = spark.createDataFrame([("c", k, "X", 10.2 + k, 20.1) for k in range(3)], "city string, place int, basin_id string, plat double, plon double")
    when = lambda d: spark.createDataFrame([("c", "X", datetime.datetime(2024, 5, d, 1))], "city string, basin_id string, at timestamp_ntz")
    same, other = (storm.landfall_day_wind(points, when(d), t).first().wind for d in (1, 3))
    last = storm.landfall_day_wind(points, when(1), t.where("lat = 10.5")).first().wind
    assert other == pytest.approx(last) and same >= last > 0


SERIES = [0, -0.2, -0.3, -0.1, 0.1, 0.2, 0.3]


@pytest.mark.parametrize(
    "values,method,run,want",
    [
        (SERIES, "consecutive", 2, (0, 1, 4, 3, "Recovered")),
        (SERIES, "consecutive", 4, (0, 1, 6, 5, "Ongoing")),
        (SERIES, "first_return", 2, (0, 1, 4, 3, "Recovered")),
        (SERIES, "end_of_series", 2, (0, 1, 6, 5, "Fixed (End of Series)")),
        ([-0.2, 0.0, -0.1, 0.1, None, 0.1, 0.2], "consecutive", 2, (0, 0, 5, 5, "Recovered")),
        ([-0.2, 0.0, -0.1], "first_return", 1, (0, 0, 1, 1, "Recovered")),
        ([0.2, 0.0, -0.01], "first_return", 1, (None, None, None, None, "None")),
        ([0.2, -0.3, float("nan"), -0.1], "first_return", 1, (0, 1, 3, 2, "Ongoing")),
    ],
)
def test_impact_period(spark, values, method, run, want):
    df = spark.createDataFrame([("a", d, None if v is None else float(v)) for d, v in enumerate(values)], "k string, day int, x double")
    r = impact_period(df, ["k"], "x", 0.05, method, run).first()
    assert (r.last_normal, r.start_index, r.end_index, r.duration, r.status) == want
    assert r.last_value == (None if want[0] is None else values[want[0]])


def test_impact_methods_are_checked(spark):
    with pytest.raises(ValueError):
        impact_period(spark.createDataFrame([], "k string, day int, x double"), ["k"], "x", method="other")
