"""Small relational steps: orders, sets, joins on constants, labels, quantiles, splits, scaling and scores of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def importance_order(rows: DataFrame, keys: list[str], value: str, ties: list[str]) -> DataFrame:
    """``place`` of each row by descending value within ``keys``, missing values last, ties by the named columns."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last(), *ties)
    return rows.withColumn("place", F.row_number().over(w))


def held_rows(every: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key is not among the used ones; also units that a cache lacks."""
    return every.join(used.select(*keys).distinct(), keys, "left_anti")


def with_constants(rows: DataFrame, constants: DataFrame, unit: str) -> DataFrame:
    """Each unit's constants beside its rows; a unit without constants raises."""
    names = [c for c in constants.columns if c != unit]
    joined = rows.join(constants.withColumn("_known", F.lit(True)), unit, "left")
    checked = F.when(F.col("_known"), True).otherwise(F.raise_error(F.concat(F.lit("no constants of unit "), F.col(unit).cast("string"))).cast("boolean"))
    return joined.withColumn("_known", checked).where("_known").select(*rows.columns, *names)


def split_check(train: set, test: set, every: set) -> str:
    """``pooled`` where both sides are the same units, else ``split``; raises on unknown or no units and on a partial overlap."""
    for side in (train, test):
        if not side or side - every:
            raise ValueError(f"empty or unknown units: {sorted(side - every)}")
    if train == test:
        return "pooled"
    if train & test:
        raise ValueError(f"units on both sides: {sorted(train & test)}")
    return "split"


def storm_of(code: Column) -> Column:
    """What follows the first underscore of a unit's code; empty without one."""
    return F.regexp_extract(code, "^[^_]*_(.*)$", 1)


def slot_label(slot: Column, hours: int) -> Column:
    """``6-8h`` for slot 3 of two hours."""
    return F.concat((slot * hours).cast("string"), F.lit("-"), ((slot + 1) * hours).cast("string"), F.lit("h"))


def is_slot_label(name: Column) -> Column:
    return name.rlike("^[0-9]+-[0-9]+h$")


def step_quantile(values: Column, p: float) -> Column:
    """The value at place floor(p * n) of the sorted array, without interpolation; p below 1."""
    n = F.size(values)
    at = F.least(F.floor(F.lit(p) * n), n - 1).cast("int")
    return F.get(F.array_sort(values), at)


def frame_hash(rows: DataFrame, columns: list[str], unit: str) -> DataFrame:
    """(unit, digest): sha256 of each unit's rows, whatever their order; equal rows count as often as they are there.

    Rows are hashed one by one, then in 4096 parts of a unit, then the parts, so that no task holds a unit."""
    row = F.sha2(F.to_json(F.struct(*columns)), 256)
    together = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "|"), 256)
    parts = rows.select(unit, row.alias("_h")).groupBy(unit, F.substring("_h", 1, 3).alias("_p")).agg(together("_h").alias("_h"))
    return parts.groupBy(unit).agg(together(F.concat("_p", "_h")).alias("digest"))


def quantile_cell(value: str, by: list[str], ties: list[str], edges: list[float]) -> Column:
    """The cell of a row's ordinal rank share (rank - 0.5) / n among ascending edges, left-open, clipped to the outer cells."""
    w = Window.partitionBy(*by)
    share = (F.row_number().over(w.orderBy(F.col(value).asc_nulls_last(), *ties)) - 0.5) / F.count("*").over(w)
    below = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < share))
    return F.greatest(F.least(below - 1, F.lit(len(edges) - 2)), F.lit(0)).cast("int")


def original_index(position: Column, start: int, lag: int) -> Column:
    """The slot of the whole series that a position of a sub-series stands for."""
    return (position + start + lag).cast("int")


def train_scaling(rows: DataFrame, value: str, is_train: Column) -> DataFrame:
    """One row: mean and sample deviation of the training part; a deviation below 1e-5 counts as one."""
    part = F.when(is_train, F.col(value))
    sd = F.stddev_samp(part)
    return rows.agg(F.avg(part).alias("mean"), F.when(sd < 1e-5, 1.0).otherwise(F.coalesce(sd, F.lit(1.0))).alias("sd"))


def scaled(rows: DataFrame, scaling: DataFrame, value: str) -> DataFrame:
    """``scaled``: the value by the training part's mean and deviation (one row)."""
    both = rows.crossJoin(F.broadcast(scaling))
    return both.withColumn("scaled", (F.col(value) - F.col("mean")) / F.col("sd")).drop("mean", "sd")


def day_split(slot: Column, slots: int, days: int, share: float) -> Column:
    """train or test, cut at a whole day: the first floor(days * share) days train."""
    return F.when(slot < int(days * share) * slots, "train").otherwise("test")


def step_scores(rows: DataFrame, step: str, truth: str, guess: str) -> DataFrame:
    """(step, n, mse, mae, r2): scores of each step ahead; r2 is null where the truth is constant."""
    e = F.col(guess) - F.col(truth)
    out = rows.where(F.col(truth).isNotNull() & F.col(guess).isNotNull()).groupBy(step)
    out = out.agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(truth).alias("_v"))
    return out.withColumn("r2", F.when(F.col("_v") > 0, 1 - F.col("mse") / F.col("_v"))).drop("_v")


def median_fold(rows: DataFrame, value: str, name: str) -> DataFrame:
    """(name, value) of the fold at place n // 2 by the value, ties by name; missing values are left out."""
    some = rows.where(F.col(value).isNotNull())
    pick = F.array_sort(F.collect_list(F.struct(value, name)))
    return some.agg(pick.alias("_s")).select(F.explode(F.array(F.get("_s", F.floor(F.size("_s") / 2).cast("int")))).alias("_p")).where("_p is not null").select(f"_p.{name}", f"_p.{value}")


def correction_units(rows: DataFrame, value: str, name: str) -> DataFrame:
    """The units of least, middle (nearest to the median, the smaller of two) and largest value."""
    some = rows.where(F.col(value).isNotNull()).select(name, value)
    bounds = F.broadcast(some.agg(F.min(value).alias("_lo"), F.median(value).alias("_mid"), F.max(value).alias("_hi")))
    found = some.crossJoin(bounds)  # one row
    at = lambda key: F.min(F.struct(F.abs(F.col(value) - F.col(key)), F.col(value), F.col(name)))[name]
    return found.agg(at("_lo").alias("least"), at("_mid").alias("middle"), at("_hi").alias("most"))


def outlines(rows: DataFrame, wkt: str) -> DataFrame:
    """Adds ``cx`` and ``cy``, the area centroid of a WKT polygon's or multipolygon's outer rings; null where there is none.

    Holes count against the area as their rings run the other way."""
    ring = r"\(([-0-9.eE+, ]+)\)"
    rings = F.expr(f"regexp_extract_all({wkt}, r'{ring}', 1)")
    points = F.transform(rings, lambda t: F.transform(F.split(F.trim(t), r"\s*,\s*"), lambda p: F.transform(F.split(p, r"\s+"), lambda v: v.cast("double"))))
    edges = lambda r: F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), lambda a, b: F.struct(a[0].alias("x"), a[1].alias("y"), b[0].alias("u"), b[1].alias("v")))
    cross = lambda e: e["x"] * e["v"] - e["u"] * e["y"]
    total = lambda f: F.aggregate(F.flatten(F.transform("_rings", edges)), F.lit(0.0), lambda a, e: a + f(e))
    out = rows.withColumn("_rings", points).withColumn("_area", total(cross))
    mean = lambda a, b: F.try_divide(total(lambda e: (e[a] + e[b]) * cross(e)), 3 * F.col("_area"))
    return out.withColumns({"cx": mean("x", "u"), "cy": mean("y", "v")}).drop("_rings", "_area")
