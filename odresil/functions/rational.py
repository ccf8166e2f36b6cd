"""Exact fractions as pairs of integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gcd(a: str, b: str, steps: int = 64) -> Column:
    """Greatest common divisor by Euclid's steps inside one expression."""
    start = F.struct(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.try_mod(s["x"], s["y"]).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["x"])


def reduced(j: str, n: str) -> tuple[Column, Column]:
    """Numerator and denominator of j / n in lowest terms."""
    g = gcd(j, n)
    return F.expr(f"{j}").cast("long").__truediv__(g).cast("long").alias("num"), F.expr(f"{n}").cast("long").__truediv__(g).cast("long").alias("den")
