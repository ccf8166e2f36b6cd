"""Samples that are the same for any partitioning: the rows of least hash of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_of(*keys: str) -> Column:
    """A hash as text, the same in other engines: md5 of the keys' text, joined by commas; nulls count as empty."""
    return F.md5(F.concat_ws(",", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)).cast("binary"))


def bottom_k(rows: DataFrame, by: list[str], keys: list[str], k: int) -> DataFrame:
    """The ``k`` rows of least hash of their keys in each group, all rows of a smaller group, with their ``place`` from 1.

    Each task passes on at most k rows of a group, so a group may hold any share of the rows.  Rows of equal keys have equal
    hashes; which of them come first does not matter where nothing but the keys is asked for."""
    order = Window.partitionBy(*by).orderBy("_hash", *keys)
    return rows.withColumn("_hash", hash_of(*keys)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("_hash")
