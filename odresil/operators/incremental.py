"""Tables of results that only grow: what is there is read, what is missing is computed and appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest_of(rows: DataFrame, by: list[str], columns: list[str], *settings) -> DataFrame:
    """(by, digest) of each group's rows, whatever their order, and of some settings: another input has another digest."""
    a, b = F.xxhash64(*columns), F.xxhash64(F.lit("again"), *columns)
    text = F.concat_ws(",", F.count("*"), F.bit_xor(a), F.bit_xor(b), F.sum(a.cast("decimal(38,0)")), F.lit(repr(settings)))
    return rows.groupBy(*by).agg(F.sha2(text, 256).alias("digest"))


def known(spark, path: str, schema: str) -> DataFrame:
    """The results at ``path``; none where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def completed(wanted: DataFrame, keys: list[str], path: str, schema: str, fit: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """(results of all wanted keys, how many were computed): ``fit`` gets the keys that ``path`` has no results for.

    Results are appended in one write, so a run that fails leaves what was there.  Two runs at once may both compute a key;
    one row of each is read."""
    spark = wanted.sparkSession
    missing = wanted.join(known(spark, path, schema).select(*keys), keys, "left_anti")
    n = missing.count()
    if n:
        fit(missing).write.mode("append").parquet(path)
    there = known(spark, path, schema).dropDuplicates(keys)
    return wanted.join(there, keys), n


def bands(table: DataFrame, by: list[str], k: str = "k", mean: str = "mean", sd: str = "sd", n: Column | int = 1) -> DataFrame:
    """(by, best, for each tolerance its least and greatest k): which k have a mean within the tolerance of the least one.

    Tolerances are one and two standard errors and two deviations of the best k; of equal means the least k is best."""
    best = table.where(F.col(mean).isNotNull() & ~F.isnan(mean)).groupBy(*by).agg(F.min(F.struct(mean, k, sd)).alias("_b"))
    error = F.coalesce(F.nanvl(F.col(f"_b.{sd}"), F.lit(0.0)), F.lit(0.0))
    count = n if isinstance(n, Column) else F.lit(n)
    rows = table.join(best, by)
    out = []
    for name, width in (("1se", error / F.sqrt(count)), ("2se", 2 * error / F.sqrt(count)), ("2sd", 2 * error)):
        inside = F.col(mean) <= F.col(f"_b.{mean}") + width
        out += [F.min(F.when(inside, F.col(k))).alias(f"lo_{name}"), F.max(F.when(inside, F.col(k))).alias(f"hi_{name}")]
    return rows.groupBy(*by).agg(F.first(f"_b.{k}").alias("best"), *out)
