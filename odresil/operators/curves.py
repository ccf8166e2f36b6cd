"""Recovery curves: day-type baselines, relative activity, smoothing, coherence, resilience scalars, metrics, synthesis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odresil.config import Windows


def is_weekday(day: Column, w: Windows) -> Column:
    """Whether day ``day`` of the window is a Monday to Friday."""
    return F.pmod(day + w.first_weekday, F.lit(7)) < 5


def baselines(daily: DataFrame, keys: list[str], w: Windows, value: str = "flow") -> DataFrame:
    """(keys, weekday, base): mean of the normal days by day type; buffer days never enter."""
    normal = daily.where(F.col("day_idx") < w.normal)
    return normal.groupBy(*keys, is_weekday(F.col("day_idx"), w).alias("weekday")).agg(F.avg(value).alias("base"))


def relative_curve(daily: DataFrame, keys: list[str], w: Windows, value: str = "flow") -> DataFrame:
    """(keys, day, activity, base, r): disaster days against the baseline of their day type; null where it is not positive."""
    rows = daily.where(F.col("day_idx") >= w.disaster_start).select(*keys, (F.col("day_idx") - w.disaster_start).cast("int").alias("day"), is_weekday(F.col("day_idx"), w).alias("weekday"), F.col(value).alias("activity"))
    out = rows.join(baselines(daily, keys, w, value), [*keys, "weekday"], "left").drop("weekday")
    return out.withColumn("r", F.when(F.col("base") > 0, F.col("activity") / F.col("base")))


def _around(keys: list[str], n: int) -> Window:
    """A centred window of ``n`` days; an even one reaches one day further back."""
    return Window.partitionBy(*keys).orderBy("day").rowsBetween(-(n // 2), (n - 1) // 2)


def smooth_ratio_of_sums(curve: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """r = windowed activity over windowed baseline, windows cut at the edges."""
    w = _around(keys, n)
    total, base = F.sum("activity").over(w), F.sum("base").over(w)
    return curve.withColumn("r", F.when(base > 0, total / base))


def smooth_mean_of_ratios(curve: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """r = mean of the daily ratios in the window, missing ones skipped."""
    return curve.withColumn("r", F.avg("r").over(_around(keys, n)))


SMOOTHINGS = ("ratio_of_sums", "mean_of_ratios")


def coherent(curve: DataFrame, keys: list[str], unit: list[str], city: DataFrame, n: int = 3, smoothing: str = "ratio_of_sums") -> DataFrame:
    """Scales every component of a day by one factor so that they add up to the smoothed city curve.

    curve: (keys, day, activity, base, r smoothed, h); city: (unit, day, city_base), the baselines of the city's own flow.
    The target is the h-weighted activity over the city's baseline, smoothed as ``smoothing`` says.  A day on which both
    target and components are zero keeps its values; a city without a positive baseline, a missing ratio and an undefined
    or negative factor raise."""
    if smoothing not in SMOOTHINGS:
        raise ValueError(f"unknown smoothing {smoothing!r}")
    w = _around(unit, n)
    sums = curve.groupBy(*unit, "day").agg(
        F.sum(F.col("activity") * F.col("h")).alias("a"),
        F.sum(F.col("r") * F.col("base") * F.col("h")).alias("p"),
        F.sum(F.expr("int(r is null or isnan(r) or h is null or h < 0)")).alias("bad"),
    )
    days = sums.join(city, [*unit, "day"], "left")
    ratio = F.col("a") / F.col("city_base")
    target = F.sum("a").over(w) / F.sum("city_base").over(w) if smoothing == "ratio_of_sums" else F.avg(ratio).over(w)
    fine = (F.col("city_base") > 0) & (F.col("bad") == 0)
    days = days.withColumn("target", F.when(fine, target)).withColumn("given", F.when(fine, F.col("p") / F.col("city_base")))
    factor = F.when((F.col("target") == 0) & (F.col("given") == 0), 1.0).otherwise(F.try_divide("target", "given"))
    checked = F.when(fine & (factor >= 0), factor).otherwise(F.raise_error(F.lit("the coherence correction is undefined")).cast("double"))
    return curve.join(days.select(*unit, "day", checked.alias("factor")), [*unit, "day"]).withColumn("r", F.col("r") * F.col("factor"))


def city_baselines(daily: DataFrame, unit: list[str], w: Windows) -> DataFrame:
    """(unit, day, city_base): the baseline of the city's own flow on each disaster day; daily: (unit, day_idx, flow)."""
    return relative_curve(daily, unit, w).select(*unit, "day", F.col("base").alias("city_base"))


def city_curve(curve: DataFrame, unit: list[str], city: DataFrame) -> DataFrame:
    """(unit, day, r_city): the components' activity, restored by baseline and loading, over the city's own baseline."""
    total = curve.groupBy(*unit, "day").agg(F.sum(F.col("r") * F.col("base") * F.col("h")).alias("p"))
    return total.join(city, [*unit, "day"]).select(*unit, "day", F.try_divide("p", "city_base").alias("r_city"))


def comparison(rows: DataFrame, actual: str, baseline: str, upper: str, lower: str) -> DataFrame:
    """pct_change, pct_upper (against the lower bound) and pct_lower (against the upper bound), as fractions."""
    change = lambda to: F.try_divide(F.col(actual) - F.col(to), F.col(to))
    return rows.withColumns({"pct_change": change(baseline), "pct_upper": change(lower), "pct_lower": change(upper)})


def resilience(curve: DataFrame, keys: list[str]) -> DataFrame:
    """drop_depth, early_collapse, recovery_day, recovery_deficit and cum_loss of each curve (null where it has no value)."""
    last = F.max("day").over(Window.partitionBy(*keys))
    rows = curve.withColumn("_n", last)
    some = F.col("r").isNotNull()
    return rows.groupBy(*keys).agg(
        (1 - F.min("r")).alias("drop_depth"),
        (F.max("_n") - F.min_by("day", F.when(some, F.struct("r", "day")))).cast("int").alias("early_collapse"),
        F.when(F.count("r") > 0, F.coalesce(1 + F.max(F.when(F.col("r") < 0.9, F.col("day"))), F.lit(0))).cast("int").alias("recovery_day"),
        (1 - F.avg(F.when(F.col("day") > F.col("_n") - 3, F.col("r")))).alias("recovery_deficit"),
        F.sum(1 - F.col("r")).alias("cum_loss"),
    )


def pre_landfall_loss(daily: DataFrame, keys: list[str], w: Windows, value: str = "flow") -> DataFrame:
    """Loss from the first maximum of the buffer's relative activity to the buffer's end."""
    rows = daily.where(F.col("day_idx").between(w.normal, w.disaster_start - 1)).withColumn("weekday", is_weekday(F.col("day_idx"), w))
    rel = rows.join(baselines(daily, keys, w, value), [*keys, "weekday"]).withColumn("rel", F.when(F.col("base") > 0, F.col(value) / F.col("base"))).where("rel is not null")
    peak = F.min_by("day_idx", F.struct(-F.col("rel"), "day_idx")).over(Window.partitionBy(*keys))
    return rel.withColumn("peak", peak).where("day_idx >= peak").groupBy(*keys).agg(F.sum(1 - F.col("rel")).alias("pre_cumloss"))


def curve_metrics(pairs: DataFrame, keys: list[str], truth: str, guess: str) -> DataFrame:
    """MAE, RMSE over the truth's deviation, R2 and MAPE (zero truths skipped) of the pairs where both are present."""
    e, t = F.col(guess) - F.col(truth), F.col(truth)
    some = pairs.where(t.isNotNull() & F.col(guess).isNotNull() & ~F.isnan(t) & ~F.isnan(guess))
    g = some.groupBy(*keys) if keys else some.groupBy()
    out = g.agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.stddev_pop(truth).alias("sd"), F.avg(F.when(t != 0, F.abs(e) / F.abs(t))).alias("mape"))
    return out.withColumn("nrmse", F.try_divide("rmse", F.when(F.col("sd") > 0, F.col("sd")))).withColumn("r2", 1 - F.pow(F.col("nrmse"), 2)).drop("rmse", "sd")


def logistic(day: Column, r0: Column, alpha: Column, level: Column) -> Column:
    """level / (1 + (level / r0 - 1) exp(-alpha day))."""
    return level / (1 + (level / r0 - 1) * F.exp(-alpha * day))


def pulse(day: Column, strength: Column, rate: Column) -> Column:
    """The surge strength * day * exp(-rate day)."""
    return strength * day * F.exp(-rate * day)


def rolling_full(rows: DataFrame, keys: list[str], at: str, value: str, n: int) -> Column:
    """Trailing mean of ``n`` values, null until that many have been seen."""
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(w) == n, F.avg(value).over(w))
