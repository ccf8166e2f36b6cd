"""Nearest rows in time and on the globe, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from odresil.operators import nearest as op
from odresil.plans.registry import query
from odresil.sources.testdata import table

#: Where customers and suppliers are taken to be: multipliers of their keys for hundredths of a degree (fixed values).
PLACES = {"c": (37, 91), "s": (4099, 7919)}


def place(key: str, side: str, lat: str, lon: str):
    """Latitude within 60 degrees and longitude of a key."""
    a, b = PLACES[side]
    return ((F.col(key) * a % 12_000) / F.lit(100.0) - 60).alias(lat), ((F.col(key) * b % 36_000) / F.lit(100.0) - 180).alias(lon)


_AT = "(({key} * {a} % 12000) / 100.0 - 60)::DOUBLE AS {lat}, (({key} * {b} % 36000) / 100.0 - 180)::DOUBLE AS {lon}"
_KM = "2 * 6371.0088 * asin(sqrt(power(sin((radians(plat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(plat)) * power(sin((radians(plon) - radians(lon)) / 2), 2)))"


@query(f"""WITH c AS (SELECT c_custkey, {_AT.format(key="c_custkey", a=PLACES["c"][0], b=PLACES["c"][1], lat="lat", lon="lon")} FROM customer),
s AS (SELECT s_suppkey, {_AT.format(key="s_suppkey", a=PLACES["s"][0], b=PLACES["s"][1], lat="plat", lon="plon")} FROM supplier),
p AS (SELECT c_custkey, s_suppkey, {_KM} AS km FROM c, s)
SELECT c_custkey, arg_min(s_suppkey, (km, s_suppkey)) AS s_suppkey, round(min(km), 3) AS km FROM p GROUP BY 1""")
def nearest_supplier(spark, sf_dir):
    """Each customer's nearest supplier on the globe."""
    asked = table(spark, sf_dir, "customer").select("c_custkey", *place("c_custkey", "c", "lat", "lon"))
    points = table(spark, sf_dir, "supplier").select("s_suppkey", *place("s_suppkey", "s", "plat", "plon"))
    out = op.nearest_on_globe(asked, points, [], "c_custkey", F.col("s_suppkey"), degrees=2.0)
    return out.select("c_custkey", F.col("near.row").alias("s_suppkey"), F.round("near.far", 3).alias("km"))


@query("""WITH e AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS t FROM events WHERE event_type = 'error'),
p AS (SELECT event_id AS near_id, user_id, floor(epoch(ts))::BIGINT AS pt FROM events WHERE event_type = 'purchase')
SELECT e.event_id, arg_min(near_id, (abs(t - pt), near_id)) FILTER (near_id IS NOT NULL) AS near_id, min(abs(t - pt)) AS seconds FROM e LEFT JOIN p USING (user_id) GROUP BY 1""")
def nearest_purchase(spark, sf_dir):
    """The purchase nearest in time to each of the same user's errors, before or after it."""
    events = table(spark, sf_dir, "events")
    asked = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    points = events.where("event_type = 'purchase'").select(F.col("event_id").alias("near_id"), "user_id", F.col("ts").alias("near_ts"))
    out = op.nearest_in_time(asked, points, ["user_id"], "event_id", "ts", "near_ts", F.col("near_id"), 4 * 3600)
    return out.select("event_id", F.col("near.row").alias("near_id"), F.col("near.far").alias("seconds"))
