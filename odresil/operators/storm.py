"""Storm layer: track parsing, interpolation, exposure, wind field, distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odresil.config import NM_KM
from odresil.functions.geo import haversine, quadrant


def parse_tracks(lines: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Ragged best-track text (n, line) as records: a header row names the storm of the rows that follow it.

    ``keys`` name columns (a file, say) within which lines are numbered; each of their values is read by itself.
    -999 radii are null; latitudes and longitudes carry their hemisphere as a suffix."""
    part = F.transform(F.split("line", ","), lambda x: F.trim(x))
    rows = lines.withColumn("p", part).withColumn("head", F.when(F.col("line").rlike("^[A-Z]{2}[0-9]{6},"), F.get("p", F.lit(0))))
    rows = rows.withColumn("basin_id", F.last("head", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("n"))).where("head is null and size(p) > 6")

    def degrees(k: int, negative: str) -> Column:
        x = F.get("p", F.lit(k))
        return F.expr(f"cast(substring(p[{k}], 1, length(p[{k}]) - 1) as double)") * F.when(x.endswith(negative), -1.0).otherwise(1.0)

    radius = lambda k: F.expr(f"nullif(cast(p[{k}] as double), -999D)")
    return rows.select(
        "basin_id",
        F.to_timestamp_ntz(F.concat(F.get("p", F.lit(0)), F.get("p", F.lit(1))), F.lit("yyyyMMddHHmm")).alias("time"),
        F.get("p", F.lit(3)).alias("status"),
        degrees(4, "S").alias("lat"),
        degrees(5, "W").alias("lon"),
        F.expr("cast(p[6] as double)").alias("wind_kt"),
        *[F.array(*[radius(a + q) for q in range(4)]).alias(name) for name, a in (("r34", 8), ("r50", 12), ("r64", 16))],
    )


def interpolate(track: DataFrame, minutes: int = 15) -> DataFrame:
    """(basin_id, time, lat, lon, wind_kt) every ``minutes`` between records; the last record itself is left out."""
    w = Window.partitionBy("basin_id").orderBy("time")
    seg = track.select("basin_id", "time", "lat", "lon", "wind_kt", *[F.lead(c).over(w).alias(f"{c}2") for c in ("time", "lat", "lon", "wind_kt")]).where("time2 is not null")
    span = F.expr("timestampdiff(SECOND, time, time2)")
    grid = seg.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), span - 1, F.lit(minutes * 60).cast("long")))).withColumn("f", F.col("s") / span)
    lerp = lambda c: (F.col(c) + (F.col(f"{c}2") - F.col(c)) * F.col("f")).alias(c)
    return grid.select("basin_id", F.expr("timestampadd(SECOND, s, time)").alias("time"), lerp("lat"), lerp("lon"), lerp("wind_kt"))


def at_place(places: DataFrame, points: DataFrame) -> DataFrame:
    """Every place with every point of its storm's track and the distance; tracks are a few hundred points a storm."""
    rows = places.join(points, "basin_id")
    return rows.withColumn("km", haversine(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon")))


def windowed(track: DataFrame, windows: DataFrame) -> DataFrame:
    """The records inside each storm's window (basin_id, start, end); a storm that keeps fewer than two keeps them all."""
    rows = track.join(windows, "basin_id", "left")
    inside = F.coalesce(F.col("time").between(F.col("start"), F.col("end")), F.lit(True))
    rows = rows.withColumn("_in", inside).withColumn("_n", F.sum(F.col("_in").cast("int")).over(Window.partitionBy("basin_id")))
    return rows.where((F.col("_n") < 2) | F.col("_in")).drop("start", "end", "_in", "_n")


def closest_approach(places: DataFrame, track: DataFrame) -> DataFrame:
    """(place, ..., km, time, wind_kt, clat, clon): the nearest interpolated point, the first of equally near ones."""
    rows = at_place(places, interpolate(track))
    near = rows.groupBy("place", "basin_id", "plat", "plon").agg(F.min(F.struct("km", "time", "wind_kt", "lat", "lon")).alias("m"))
    named = {"km": "km", "time": "time", "wind_kt": "wind_kt", "lat": "clat", "lon": "clon"}
    return near.select("place", "basin_id", "plat", "plon", *[F.col(f"m.{a}").alias(b) for a, b in named.items()])


def nearest_record(rows: DataFrame, track: DataFrame) -> DataFrame:
    """As-of join: the radii of the track record nearest in time to each row's ``time``, the earlier of two, by place and storm."""
    t = track.select("basin_id", F.col("time").alias("rtime"), "r34", "r50", "r64")
    gap = F.abs(F.expr("timestampdiff(SECOND, rtime, time)"))
    both = rows.join(t, "basin_id").withColumn("gap", gap)
    best = both.groupBy("place", "basin_id").agg(F.min(F.struct("gap", "rtime")).alias("b"))
    best = best.select("place", "basin_id", F.col("b.rtime").alias("rtime"))
    return both.join(best, ["place", "basin_id", "rtime"]).drop("gap")


def exposure_band(rows: DataFrame) -> DataFrame:
    """``quadrant`` and ``band``: 64, 50, 34 or 0, by the record's radii in the quadrant in which the place lies, seen from
    the interpolated centre; a radius of 0 or null reaches nothing."""
    q = quadrant(F.col("plat") - F.col("clat"), F.col("plon") - F.col("clon"))
    reach = lambda r: F.get(r, F.col("quadrant")) * NM_KM
    inside = lambda r: F.coalesce((reach(r) > 0) & (F.col("km") <= reach(r)), F.lit(False))
    band = F.when(inside("r64"), 64).when(inside("r50"), 50).when(inside("r34"), 34).otherwise(0)
    return rows.withColumn("quadrant", q).withColumn("band", band)


def rankine_wind(km: Column, vmax: Column, r34: Column, r50: Column, r64: Column) -> Column:
    """Wind in knots at a distance, from the radii of its quadrant in kilometres; 0: not reached, null: not analysed.

    Inside the 64-knot radius it rises to ``vmax`` at the centre, between two radii it is linear, beyond the outermost it
    falls as 34 (r34 / d)^0.6.  Where an inner radius is 0 the line starts from ``vmax``; a null radius gives no branch."""
    line = lambda top, low, near, far: top + (low - top) * (km - near) / (far - near)
    from64 = F.when(r64 > 0, 64.0).otherwise(vmax)
    from50 = F.when(r50 > 0, 50.0).when(r64 > 0, 64.0).otherwise(vmax)
    wind = (
        F.when((r34 > 0) & (km > r34), 34 * F.pow(r34 / km, 0.6))
        .when((r34 > r50) & (km > r50) & (km <= r34), line(from50, F.lit(34.0), r50, r34))
        .when((r50 > r64) & (km > r64) & (km <= r50), line(from64, F.lit(50.0), r64, r50))
        .when((r64 > 0) & (km <= r64), 64 + (vmax - 64) * (1 - km / r64))
    )
    return F.greatest(F.coalesce(wind, F.lit(0.0)), F.lit(0.0))


def wind_at(places: DataFrame, track: DataFrame) -> DataFrame:
    """Every (place, record) with the wind there."""
    rows = at_place(places, track)
    q = quadrant(F.col("plat") - F.col("lat"), F.col("plon") - F.col("lon"))
    radii = [F.get(r, q) * NM_KM for r in ("r34", "r50", "r64")]
    return rows.withColumn("wind", rankine_wind(F.col("km"), F.col("wind_kt"), *radii))


def landfall_day_wind(points: DataFrame, when: DataFrame, track: DataFrame) -> DataFrame:
    """(city, wind): mean over a city's points of the strongest wind on the day of its own closest approach.

    points: (city, place, basin_id, plat, plon); when: (city, basin_id, at).  Without a record on that day the nearest one
    counts, the earlier of two."""
    rows = track.join(when, "basin_id")
    by = Window.partitionBy("city")
    rows = rows.withColumn("_same", F.to_date("time") == F.to_date("at"))
    rows = rows.withColumn("_any", F.max("_same").over(by))
    gap = F.abs(F.expr("timestampdiff(SECOND, time, at)"))
    rows = rows.withColumn("_k", F.row_number().over(by.orderBy(gap, "time")))
    rows = rows.where(F.col("_same") | (~F.col("_any") & (F.col("_k") == 1))).drop("_same", "_any", "_k", "at")
    found = at_place(points, rows.withColumnRenamed("city", "_city")).where("city = _city")
    q = quadrant(F.col("plat") - F.col("lat"), F.col("plon") - F.col("lon"))
    radii = [F.get(r, q) * NM_KM for r in ("r34", "r50", "r64")]
    winds = found.withColumn("wind", rankine_wind(F.col("km"), F.col("wind_kt"), *radii))
    return winds.groupBy("city", "place").agg(F.max("wind").alias("wind")).groupBy("city").agg(F.avg("wind").alias("wind"))
