"""Nearest neighbours in time and on the globe by buckets that grow, instead of all pairs.

A row asks in its own bucket and the ones beside it.  What it finds within one bucket's width is nearest for certain, for
everything farther away lies beyond the neighbouring buckets; rows that have found nothing so near ask again in buckets twice
as wide.  So most rows meet only what is close to them, a join is always one of equal buckets, and a bucket that holds
many points is met only by rows that lie near it or near nothing.

Rows of one place ask once, and points of one place are one point.  The first buckets are halved until a point shares its own
with few others, so a row meets no more points where there are more of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odresil.config import EARTH_KM
from odresil.functions.geo import haversine
from odresil.scratch import written


#: Points that share a bucket of the first level, as the mean over points.
CROWD = 8
#: Times that cells of the globe are halved at most.
FINEST = -16


def grown(asked: DataFrame, points: DataFrame, by: list[str], place: list[str], point_place: list[str], cells: Callable[[int], tuple[Column, Column]], far: Column, certain: Callable[[int], Column], take: Column, levels: int, least: int) -> DataFrame:
    """``asked`` with ``near``, the least (distance, ``take``) of all points of equal ``by``; null where there is none.

    ``cells(level)`` gives the buckets in which a row asks, as an array, and the one in which a point lies; ``certain(level)``
    the distance up to which nothing nearer can be elsewhere.  In the last level everything is certain.  The first level is 0
    or, where points are dense, a lower one, ``least`` at the lowest.  ``place`` and ``point_place`` are the columns that
    the distance depends on."""
    key = [*by, *place]
    points = written(points.groupBy(*by, *point_place).agg(F.min(take).alias("_take")), "points")
    out, open_, first = None, written(asked.select(*key).distinct(), "places"), 0
    while first > least:
        held = points.groupBy(*by, cells(first)[1].alias("_cell")).agg(F.count("*").cast("double").alias("n"))
        shared = held.agg(F.try_divide(F.sum(F.col("n") * F.col("n")), F.sum("n"))).first()[0]
        if (shared or 0) <= CROWD:
            break
        first -= 1
    for level in range(first, levels):
        mine, theirs = cells(level)
        rows = open_.withColumn("_cell", F.explode(F.array_distinct(mine))).join(points.withColumn("_cell", theirs), [*by, "_cell"])
        best = rows.groupBy(*key).agg(F.min(F.struct(far.alias("far"), F.col("_take").alias("row"))).alias("near"))
        joined = written(open_.join(best, key, "left"), "nearest")
        settled = F.lit(level == levels - 1) | F.coalesce(F.col("near.far") <= certain(level), F.lit(False))
        part = joined.where(settled)
        out = part if out is None else out.unionByName(part)
        open_ = joined.where(~settled).drop("near")
        if level == levels - 1 or not open_.limit(1).count():
            break
    return asked.join(out, key, "left").select(*asked.columns, "near")


def nearest_in_time(asked: DataFrame, points: DataFrame, by: list[str], key: str, at: str, point_at: str, take: Column, seconds: int = 3600) -> DataFrame:
    """Each row's nearest point in time (``near.far`` seconds, the least ``take`` of equally near ones); times are whole seconds."""
    mine, theirs = F.unix_timestamp(at), F.unix_timestamp(point_at)
    ends = lambda rows, t: rows.agg(F.min(t), F.max(t)).first()
    known = [x for x in (*ends(asked, mine), *ends(points, theirs)) if x is not None]
    span, levels = (max(known) - min(known) if known else 0), 1
    while seconds * 2 ** (levels - 1) < span:
        levels += 1
    bucket = lambda t, level: F.floor(t / F.lit(float(seconds) * 2.0**level)).cast("long")
    around = lambda level: F.array(*(bucket(mine, level) + k for k in (-1, 0, 1)))
    least = -max(0, int(seconds).bit_length() - 1)  # buckets of a second
    return grown(asked, points, by, [at], [point_at], lambda level: (around(level), bucket(theirs, level)), F.abs(mine - theirs), lambda level: F.lit(float(seconds) * 2.0**level), take, levels, least)


def nearest_on_globe(asked: DataFrame, points: DataFrame, by: list[str], key: str, take: Column, degrees: float = 1.0) -> DataFrame:
    """Each row's nearest point (``near.far`` km, the least ``take`` of equally near ones); asked: (key, lat, lon), points:
    (plat, plon).

    A cell is some degrees wide; columns of cells go round the globe.  Outside the cells beside its own a point differs by
    a cell's width in latitude or longitude, so it is no nearer than the meridian so far off is from the row."""
    levels = 1
    while degrees * 2 ** (levels - 1) < 360:
        levels += 1

    def cells(level: int) -> tuple[Column, Column]:
        width = degrees * 2**level
        columns = max(1, int(-(-360 // width)))
        whole = float(columns) * width == 360.0  # else the last column is narrower than the others: one more on each side
        row = lambda lat: F.floor((lat + 90) / width).cast("long")
        column = lambda lon: F.floor(F.pmod(lon + 180, F.lit(360.0)) / width).cast("long")
        name = lambda a, b: F.pmod(b, F.lit(columns)) + F.lit(columns) * (a + 2)
        steps = range(-1, 2) if whole else range(-2, 3)
        return F.array(*(name(row(F.col("lat")) + a, column(F.col("lon")) + b) for a in (-1, 0, 1) for b in steps)), name(row(F.col("plat")), column(F.col("plon")))

    def certain(level: int) -> Column:
        width = F.radians(F.lit(min(degrees * 2**level, 90.0)))
        return F.lit(EARTH_KM) * F.asin(F.cos(F.radians("lat")) * F.sin(width)) * (1 - 1e-9)

    distance = haversine(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))
    return grown(asked, points, by, ["lat", "lon"], ["plat", "plon"], cells, distance, certain, take, levels, FINEST)
