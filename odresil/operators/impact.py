"""Impact periods of a relative-change series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METHODS = ("first_return", "consecutive", "end_of_series")


def impact_period(series: DataFrame, keys: list[str], x: str, buffer: float = 0.0, method: str = "first_return", run: int = 3) -> DataFrame:
    """(keys, last_normal, last_value, start_index, end_index, duration, status) of each series (keys, day, x), days from 0.

    An impact starts at the first value below -buffer.  It ends at the first value at or above zero (first_return), at the
    first of ``run`` such values in a row (consecutive), or with the series (end_of_series); one that does not return is
    Ongoing up to the last day.  Missing values are neither.  A series without an impact has the status ``None`` and nulls."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    by, by_day = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("day")
    value = F.nanvl(F.col(x).cast("double"), F.lit(None).cast("double"))
    rows = series.select(*keys, "day", value.alias("_x"))
    start = F.min(F.when(F.col("_x") < -buffer, F.col("day"))).over(by)
    rows = rows.withColumn("_start", start).withColumn("_last", F.max("day").over(by))
    up = (F.col("day") >= F.col("_start")) & F.coalesce(F.col("_x") >= 0, F.lit(False))
    rows = rows.withColumn("_up", up).withColumn("_island", F.sum((~F.col("_up")).cast("int")).over(by_day))
    rows = rows.withColumn("_run", F.sum(F.col("_up").cast("int")).over(Window.partitionBy(*keys, "_island").orderBy("day")))
    need = run if method == "consecutive" else 1
    back = F.min(F.when(F.col("_up") & (F.col("_run") == need), F.col("day") - (need - 1)))
    normal = F.when(F.col("_start").isNotNull(), F.greatest(F.col("_start") - 1, F.lit(0)))
    out = rows.groupBy(*keys).agg(
        F.first("_start").cast("int").alias("start_index"),
        F.first("_last").cast("int").alias("_last"),
        F.max(F.when(F.col("day") == normal, F.col("_x"))).alias("last_value"),
        back.cast("int").alias("_back"),
    )
    some, end = F.col("start_index").isNotNull(), F.lit(None).cast("int") if method == "end_of_series" else F.col("_back")
    status = F.lit("Fixed (End of Series)") if method == "end_of_series" else F.when(end.isNotNull(), "Recovered").otherwise("Ongoing")
    out = out.withColumn("end_index", F.when(some, F.coalesce(end, "_last")))
    return out.select(
        *keys,
        F.greatest(F.col("start_index") - 1, F.when(some, F.lit(0))).alias("last_normal"),
        "last_value",
        "start_index",
        "end_index",
        (F.col("end_index") - F.col("start_index")).alias("duration"),
        F.when(some, status).otherwise("None").alias("status"),
    )
