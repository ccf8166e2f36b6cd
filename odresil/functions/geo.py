"""Geographic column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odresil.config import EARTH_KM

#: FIPS codes of the states (fixed values).
STATES = dict(zip("AL AK AZ AR CA CO CT DE DC FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY".split(), "01 02 04 05 06 08 09 10 11 12 13 15 16 17 18 19 20 21 22 23 24 25 26 27 28 29 30 31 32 33 34 35 36 37 38 39 40 41 42 44 45 46 47 48 49 50 51 53 54 55 56".split()))


def fips(zone: Column) -> Column:
    """The 12-digit block group of ``US.<state>.<county>.<tract>.<group>``; null where the id is malformed."""
    p = F.split(zone, "[.]")
    code = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    state = F.try_element_at(code, F.get(p, F.lit(1)))
    ok = (F.size(p) == 5) & (F.get(p, F.lit(0)) == "US") & state.isNotNull()
    return F.when(ok, F.concat(state, F.lpad(F.get(p, F.lit(2)), 3, "0"), F.lpad(F.get(p, F.lit(3)), 6, "0"), F.get(p, F.lit(4))))


def mercator_x(lon) -> Column:
    return F.radians(lon) * 6378137.0


def mercator_y(lat) -> Column:
    return F.log(F.tan(F.lit(3.141592653589793 / 4) + F.radians(lat) / 2)) * 6378137.0


def od_distance(pairs: DataFrame, centres: DataFrame) -> DataFrame:
    """Kilometres between the centres (zone, cx, cy) of both ends; pairs with an unknown end raise."""
    o = centres.select(F.col("zone").alias("origin"), F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    d = centres.select(F.col("zone").alias("dest"), F.col("cx").alias("dx"), F.col("cy").alias("dy"))
    km = F.sqrt(F.pow(F.col("ox") - F.col("dx"), 2) + F.pow(F.col("oy") - F.col("dy"), 2)) / 1000
    known = F.col("ox").isNotNull() & F.col("dx").isNotNull()
    rows = pairs.join(o, "origin", "left").join(d, "dest", "left")
    return rows.select("origin", "dest", F.when(known, km).otherwise(F.raise_error(F.lit("a zone has no centre"))).alias("km"))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle kilometres."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(h))


def quadrant(north: Column, east: Column) -> Column:
    """Storm-relative quadrant: 0 NE, 1 SE, 2 SW, 3 NW; on an axis the north or east side."""
    return F.when(north >= 0, F.when(east >= 0, 0).otherwise(3)).otherwise(F.when(east >= 0, 1).otherwise(2))
