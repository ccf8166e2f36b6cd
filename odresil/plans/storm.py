"""Queries of the storm layer over a short synthetic track (the driver's tables have none); places are nations moved near it."""

from __future__ import annotations

from pyspark.sql import functions as F

from odresil.operators import storm as op
from odresil.plans.curves import rounded
from odresil.plans.registry import query
from odresil.sources.testdata import table

LINES = [
    "AL012024,              ALPHA,      4,",
    "20240118, 0000,  , TS, 24.0N,  80.0W,  45, 1000,   90,   60,   40,   80,    0,    0,    0,    0,    0,    0,    0,    0,",
    "20240118, 0600,  , HU, 25.5N,  81.0W,  70,  985,  120,  100,   80,  100,   60,   50,   40,   50,   30,   25,    0,   20,",
    "20240118, 1200,  , HU, 27.0N,  82.5W,  85,  970,  150,  120,  100,  130,   80,   60,   50,   70,   40,   35,   30,   35,",
    "20240118, 1800,  , TS, 28.5N,  82.0W,  55,  990, -999, -999, -999, -999, -999, -999, -999, -999, -999, -999, -999, -999,",
    "AL022024,               BETA,      2,",
    "20240120, 0000,  , TD, 10.0S,  60.0E,  30, 1005,    0,    0,    0,    0,    0,    0,    0,    0,    0,    0,    0,    0,",
    "20240120, 0600,  , TS, 11.0S,  61.0E,  40, 1000,   60,   50,    0,   50,    0,    0,    0,    0,    0,    0,    0,    0,",
]
TEXT = "ln(n, line) AS (VALUES " + ", ".join(f"({k}, '{x}')" for k, x in enumerate(LINES)) + ")"
TRACK = f"""{TEXT}, p0 AS (SELECT n, line, list_transform(string_split(line, ','), lambda x: trim(x)) AS p, CASE WHEN regexp_matches(line, '^[A-Z]{{2}}[0-9]{{6}},') THEN trim(string_split(line, ',')[1]) END AS head FROM ln),
p1 AS (SELECT *, last_value(head IGNORE NULLS) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS basin_id FROM p0),
tr AS (SELECT basin_id, strptime(p[1] || p[2], '%Y%m%d%H%M') AS time, p[4] AS status, p[5][1:-2]::DOUBLE * CASE WHEN p[5][-1:] = 'S' THEN -1 ELSE 1 END AS lat,
  p[6][1:-2]::DOUBLE * CASE WHEN p[6][-1:] = 'W' THEN -1 ELSE 1 END AS lon, p[7]::DOUBLE AS wind_kt,
  {", ".join(f"nullif(p[{a + q + 1}]::DOUBLE, -999) AS {r}_{q}" for r, a in (("r34", 8), ("r50", 12), ("r64", 16)) for q in range(4))} FROM p1 WHERE head IS NULL)"""
SEGS = TRACK + """, sg AS (SELECT basin_id, time, lat, lon, wind_kt, lead(time) OVER w AS time2, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lead(wind_kt) OVER w AS wind2 FROM tr WINDOW w AS (PARTITION BY basin_id ORDER BY time)),
ip AS (SELECT basin_id, time + to_seconds(s) AS time, lat + (lat2 - lat) * s / 21600.0 AS lat, lon + (lon2 - lon) * s / 21600.0 AS lon, wind_kt + (wind2 - wind_kt) * s / 21600.0 AS wind_kt
  FROM sg, (SELECT unnest(range(0, 21600, 900)) AS s) WHERE time2 IS NOT NULL)"""
PLACES = "pl AS (SELECT n_nationkey AS place, 'AL012024' AS basin_id, 24.0 + n_nationkey * 0.2::DOUBLE AS plat, -84.0 + (n_nationkey * 7 % 25) * 0.2::DOUBLE AS plon FROM nation)"
KM = "(2 * 6371.0088 * asin(sqrt(power(sin((radians({b}lat) - radians(plat)) / 2), 2) + cos(radians(plat)) * cos(radians({b}lat)) * power(sin((radians({b}lon) - radians(plon)) / 2), 2))))"
RADIUS = "((CASE q WHEN 0 THEN {r}_0 WHEN 1 THEN {r}_1 WHEN 2 THEN {r}_2 ELSE {r}_3 END) * 1.852)"
QUAD = "CASE WHEN plat - {b}lat >= 0 THEN CASE WHEN plon - {b}lon >= 0 THEN 0 ELSE 3 END ELSE CASE WHEN plon - {b}lon >= 0 THEN 1 ELSE 2 END END"


def track(spark):
    return op.parse_tracks(spark.createDataFrame(list(enumerate(LINES)), "n int, line string"))


def places(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("place"), F.lit("AL012024").alias("basin_id"))
    return n.withColumn("plat", 24.0 + F.col("place") * F.lit(0.2)).withColumn("plon", -84.0 + (F.col("place") * 7 % 25) * F.lit(0.2))


@query(f"WITH {TRACK} SELECT basin_id, time, status, lat, lon, wind_kt, r34_0 AS r34_ne, r50_1 AS r50_se, r64_2 AS r64_sw FROM tr")
def track_parse(spark, sf_dir):
    return track(spark).select("basin_id", "time", "status", "lat", "lon", "wind_kt", F.get("r34", F.lit(0)).alias("r34_ne"), F.get("r50", F.lit(1)).alias("r50_se"), F.get("r64", F.lit(2)).alias("r64_sw"))


@query(f"WITH {SEGS} SELECT basin_id, time, round(lat, 6) AS lat, round(lon, 6) AS lon, round(wind_kt, 6) AS wind_kt FROM ip")
def track_interpolate(spark, sf_dir):
    return rounded(op.interpolate(track(spark)), "lat", "lon", "wind_kt")


@query(f"""WITH {SEGS}, {PLACES}, j AS (SELECT place, plat, plon, ip.*, {KM.format(b="")} AS km FROM pl JOIN ip USING (basin_id)),
ca AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY km, time) AS k FROM j) WHERE k = 1),
rc AS (SELECT * FROM (SELECT ca.place, ca.plat, ca.plon, ca.km, ca.time, ca.wind_kt, ca.lat AS clat, ca.lon AS clon, {", ".join(f"{r}_{q}" for r in ("r34", "r50", "r64") for q in range(4))},
  row_number() OVER (PARTITION BY place ORDER BY abs(epoch(ca.time) - epoch(tr.time)), tr.time) AS k2 FROM ca JOIN tr USING (basin_id)) WHERE k2 = 1),
qd AS (SELECT *, {QUAD.format(b="c")} AS q FROM rc)
SELECT place, time, round(km, 6) AS km, round(wind_kt, 6) AS wind_kt, CASE {" ".join(f"WHEN {RADIUS.format(r=r)} > 0 AND km <= {RADIUS.format(r=r)} THEN {v}" for r, v in (("r64", 64), ("r50", 50), ("r34", 34)))} ELSE 0 END::INT AS band FROM qd""")
def city_exposure(spark, sf_dir):
    t = track(spark)
    near = op.nearest_record(op.closest_approach(places(spark, sf_dir), t), t)
    return rounded(op.exposure_band(near), "km", "wind_kt").select("place", "time", "km", "wind_kt", "band")


#: The wind at a distance by the rules of the surveyed profile, one branch after the other, the last that holds.
PROFILE = """greatest(coalesce(
  CASE WHEN r34 > 0 AND km > r34 THEN 34.0 * power(r34 / km, 0.6) END,
  CASE WHEN r34 > r50 AND km > r50 AND km <= r34 THEN i50 + (34.0 - i50) * (km - r50) / (r34 - r50) END,
  CASE WHEN r50 > r64 AND km > r64 AND km <= r50 THEN i64 + (50.0 - i64) * (km - r64) / (r50 - r64) END,
  CASE WHEN r64 > 0 AND km <= r64 THEN 64.0 + (wind_kt - 64.0) * (1.0 - km / r64) END, 0.0), 0.0)"""
PROFILED = """rd AS (SELECT *, """ + ", ".join(RADIUS.format(r=r) + f" AS {r}" for r in ("r34", "r50", "r64")) + """ FROM j),
an AS (SELECT *, CASE WHEN r64 > 0 THEN 64.0 ELSE wind_kt END AS i64, CASE WHEN r50 > 0 THEN 50.0 WHEN r64 > 0 THEN 64.0 ELSE wind_kt END AS i50 FROM rd),
wd AS (SELECT *, """ + PROFILE + """ AS wind FROM an)"""
WIND = f"""{TRACK}, {PLACES}, j AS (SELECT place, plat, plon, tr.*, {KM.format(b="")} AS km, {QUAD.format(b="")} AS q FROM pl JOIN tr USING (basin_id)), {PROFILED}"""


@query(f"WITH {WIND} SELECT place, round(max(wind)::DOUBLE, 6) AS wind FROM wd GROUP BY 1")
def wind_field(spark, sf_dir):
    return op.wind_at(places(spark, sf_dir), track(spark)).groupBy("place").agg(F.round(F.max("wind"), 6).alias("wind"))


@query(f"WITH {SEGS}, {PLACES} SELECT place, round(min({KM.format(b='')}), 6) AS km FROM pl JOIN ip USING (basin_id) GROUP BY 1")
def track_distance(spark, sf_dir):
    return op.at_place(places(spark, sf_dir), op.interpolate(track(spark))).groupBy("place").agg(F.round(F.min("km"), 6).alias("km"))


CITY = "place % 5"


@query(f"""WITH {SEGS}, {PLACES}, ct AS (SELECT {CITY} AS city, basin_id, avg(plat) AS plat, avg(plon) AS plon FROM pl GROUP BY 1, 2),
cj AS (SELECT city, ip.time, {KM.format(b="")} AS km FROM ct JOIN ip USING (basin_id)),
ap AS (SELECT city, time AS landed FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY km, time) AS k FROM cj) WHERE k = 1),
dr AS (SELECT ap.city, tr.*, tr.time::DATE = landed::DATE AS same, row_number() OVER (PARTITION BY ap.city ORDER BY abs(epoch(tr.time) - epoch(landed)), tr.time) AS near
  FROM ap JOIN ct USING (city) JOIN tr USING (basin_id)),
us AS (SELECT * FROM (SELECT *, bool_or(same) OVER (PARTITION BY city) AS found FROM dr) WHERE same OR (NOT found AND near = 1)),
j AS (SELECT us.*, place, plat, plon, {KM.format(b="")} AS km, {QUAD.format(b="")} AS q FROM us JOIN pl ON {CITY} = city AND pl.basin_id = us.basin_id), {PROFILED}
SELECT city, round(avg(wind), 6) AS wind FROM (SELECT city, place, max(wind) AS wind FROM wd GROUP BY 1, 2) GROUP BY 1""")
def landfall_day_wind(spark, sf_dir):
    t, points = track(spark), places(spark, sf_dir).withColumn("city", F.col("place") % 5)
    centres = points.groupBy(F.col("city").alias("place"), "basin_id").agg(F.avg("plat").alias("plat"), F.avg("plon").alias("plon"))
    when = op.closest_approach(centres, t).select(F.col("place").alias("city"), "basin_id", F.col("time").alias("at"))
    return rounded(op.landfall_day_wind(points, when, t), "wind")
