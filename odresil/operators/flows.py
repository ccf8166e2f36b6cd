"""Flow layer: trimming, windows, activity filters, pivots, diagnostics, totals, line graphs, lags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odresil.config import Windows
from odresil.operators.ordering import numbered


def trim_slots(flows: DataFrame, w: Windows) -> DataFrame:
    """Keeps the slots of the day between the first and last active one."""
    return flows.where(F.pmod("slot_idx", F.lit(w.slots)).between(w.first_slot, w.last_slot))


def trailing_days(flows: DataFrame, days: int, slots: int) -> DataFrame:
    """The last ``days`` whole days of the series, slots counted from the window's start."""
    end = flows.agg(((F.floor(F.max("slot_idx") / slots) + 1) * slots).cast("int").alias("end"))
    rows = flows.crossJoin(F.broadcast(end)).where(F.col("slot_idx") >= F.col("end") - days * slots)  # one row
    return rows.withColumn("slot_idx", (F.col("slot_idx") - F.col("end") + days * slots).cast("int")).drop("end")


def segment(day: Column, w: Windows) -> Column:
    """normal, buffer or disaster."""
    return F.when(day < w.normal, "normal").when(day < w.disaster_start, "buffer").otherwise("disaster")


SEGMENTS = ("normal", "buffer", "disaster")


def select_segments(rows: DataFrame, names: list[str], w: Windows) -> DataFrame:
    """The rows of the named segments with their ``segment``; an unknown name raises."""
    unknown = set(names) - set(SEGMENTS)
    if unknown or not names:
        raise ValueError(f"unknown segments: {sorted(unknown)}")
    return rows.withColumn("segment", segment(F.col("day_idx"), w)).where(F.col("segment").isin(*names))


def active_pairs(flows: DataFrame, least: float | DataFrame) -> DataFrame:
    """Flows between zones whose in- plus outflow reaches ``least``, a number or a table of one; pairs without any flow go.

    A self-loop counts twice."""
    ends = flows.select(F.col("origin").alias("zone"), "flow").unionAll(flows.select("dest", "flow"))
    totals = ends.groupBy("zone").agg(F.sum("flow").alias("total"))
    if isinstance(least, DataFrame):
        totals = totals.crossJoin(F.broadcast(least.toDF("_least")))  # one row
    else:
        totals = totals.withColumn("_least", F.lit(float(least)))
    kept = totals.where(F.col("total") >= F.col("_least")).select("zone")
    some = flows.join(kept.withColumnRenamed("zone", "origin"), "origin", "left_semi").join(kept.withColumnRenamed("zone", "dest"), "dest", "left_semi")
    pairs = some.groupBy("origin", "dest").agg(F.max("flow").alias("m")).where("m > 0").select("origin", "dest")
    return some.join(pairs, ["origin", "dest"], "left_semi")


def least_activity(days: int, factor: float, slots: int = 8) -> float:
    """The activity that a zone must reach: ``factor`` for each of ``slots`` slots of every day."""
    return float(slots * days * factor)


def head_days(flows: DataFrame, meta: DataFrame, days: int | None, slots: int, label: str = "series") -> DataFrame:
    """The first ``days`` whole days of a series, after strict checks that raise.

    meta: one row (n_slots, interval_hours).  The interval must be there and be that of ``slots`` slots a day, the slots
    must make whole days, and there must be enough of them."""
    if days is None:
        raise ValueError(f"{label}: the number of days must be set")
    expected = 24 // slots
    stop = lambda text: F.raise_error(F.lit(f"{label}: {text}")).cast("boolean")
    fine = (
        F.when(F.col("interval_hours").isNull(), stop("the interval is missing"))
        .when(F.col("interval_hours") != expected, stop(f"the interval is not {expected} h"))
        .when(F.col("n_slots") % slots != 0, stop(f"the slots do not make whole days of {slots}"))
        .when(F.col("n_slots") < days * slots, stop(f"there are fewer than {days} days"))
        .otherwise(True)
    )
    rows = flows.crossJoin(F.broadcast(meta.select(fine.alias("_fine"))))  # one row
    return rows.where(F.col("_fine") & (F.col("slot_idx") < days * slots)).drop("_fine")


def sequence_lags(slots: int, recent: int = 7, days: int = 6, weeks: int = 3) -> dict[str, int]:
    """Names and distances of the recent, daily and weekly lags of a series with ``slots`` slots a day."""
    out = {f"recent_{k}": k for k in range(1, recent + 1)}
    out |= {f"day_{k}": k * slots for k in range(1, days + 1)}
    return out | {f"week_{k}": k * 7 * slots for k in range(1, weeks + 1)}


def within(at: Column, n: int) -> Column:
    """The position, or an error where it is outside 0..n-1: flow there would be lost without a word."""
    return F.when(at.between(0, n - 1), at).otherwise(F.raise_error(F.concat(F.lit(f"a position outside 0..{n - 1}: "), at.cast("string"))).cast("int"))


def packed_rows(flows: DataFrame, n_slots: int, at: str = "slot_idx") -> DataFrame:
    """One row a pair with its dense series as an array, absent edges zero, pairs numbered in order of (origin, dest)."""
    place = within(F.col(at), n_slots)
    m = flows.groupBy("origin", "dest").agg(F.map_from_entries(F.collect_list(F.struct(place.alias(at), F.col("flow")))).alias("m"))
    series = F.transform(F.sequence(F.lit(0), F.lit(n_slots - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    rows = m.select("origin", "dest", series.alias("series"))
    return numbered(rows, ["origin", "dest"], "od_idx").withColumn("od_idx", F.col("od_idx").cast("int"))


def matrix_diagnostics(flows: DataFrame, n_slots: int) -> DataFrame:
    """Zones, pairs, share of possible pairs, share of zero cells and the spread of the others, in one row."""
    zones = flows.select(F.explode(F.array("origin", "dest")).alias("z")).agg(F.countDistinct("z").alias("n_zones"))
    cells = flows.agg(
        F.countDistinct("origin", "dest").alias("n_pairs"),
        F.sum((F.col("flow") > 0).cast("long")).alias("nnz"),
        F.min(F.when(F.col("flow") > 0, F.col("flow"))).alias("min_flow"),
        F.median(F.when(F.col("flow") > 0, F.col("flow"))).alias("median_flow"),
        F.avg(F.when(F.col("flow") > 0, F.col("flow"))).alias("mean_flow"),
        F.max("flow").alias("max_flow"),
        *[F.sum(((F.col("flow") > 0) & (F.col("flow") < k)).cast("long")).alias(f"below_{k}") for k in (1, 5, 10)],
    )
    both = cells.crossJoin(zones)  # one row each
    return both.withColumn("pair_share", F.col("n_pairs") / (F.col("n_zones") * F.col("n_zones"))).withColumn("zero_share", 1 - F.col("nnz") / (F.col("n_pairs") * n_slots))


def dense_totals(flows: DataFrame, keys: list[str], at: str, n: int) -> DataFrame:
    """Sums of ``flow`` by ``keys`` and position 0..n-1, with zeros where nothing flowed; other positions raise."""
    sums = flows.groupBy(*keys, within(F.col(at), n).alias(at)).agg(F.sum("flow").alias("flow"))
    spine = flows.select(*keys).distinct() if keys else flows.sparkSession.range(1).select()
    spine = spine.withColumn(at, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return spine.join(sums, [*keys, at], "left").withColumn("flow", F.coalesce("flow", F.lit(0.0)))


def line_graph(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges e1 -> e2 of the line graph: the head of e1 is the tail of e2, within ``keys``."""
    a = edges.select(*keys, F.col("origin").alias("o1"), F.col("dest").alias("d1"))
    b = edges.select(*keys, F.col("origin").alias("o2"), F.col("dest").alias("d2"), F.col("origin").alias("d1"))
    return a.join(b, [*keys, "d1"]).select(*keys, "o1", "d1", "o2", "d2")


def lagged(series: DataFrame, keys: list[str], at: str, value: str, lags: dict[str, int]) -> DataFrame:
    """The value at earlier positions of the series."""
    w = Window.partitionBy(*keys).orderBy(at)
    return series.withColumns({name: F.lag(value, n).over(w) for name, n in lags.items()})


def disaster_clock(at: Column, start: int, end: int) -> Column:
    """1, 2, ... inside [start, end], else 0."""
    return F.when(at.between(start, end), at - start + 1).otherwise(0).cast("int")
