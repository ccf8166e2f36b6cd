"""Signals on the line graph of pairs: hops of the normalised adjacency, and training windows with their targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odresil.scratch import written


def normalised(edges: DataFrame) -> DataFrame:
    """(a, b, weight) of edges (a, b): 1 / sqrt(degree of a as a head * degree of b as a head), repeated edges counting once.

    A node that no edge leads to has no degree, and its edges weigh nothing."""
    one = edges.select("a", "b").distinct()
    degree = one.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("n"))
    ends = one.join(degree.select(F.col("node").alias("a"), F.col("n").alias("_m")), "a", "left").join(degree.select(F.col("node").alias("b"), "n"), "b")
    return ends.select("a", "b", F.coalesce(1 / F.sqrt(F.col("_m") * F.col("n")), F.lit(0.0)).alias("weight"))


def hops(values: DataFrame, edges: DataFrame, k: int, at: str = "slot_idx") -> DataFrame:
    """(node, at, hop, value), hop 0 to k: the values, and what reaches each node over one, two, ... weighted edges.

    Only values other than zero travel, each hop a join by the edge's tail and a sum by its head; each hop is written, so the
    plan of the last does not hold all others.  ``edges`` are (a, b, weight)."""
    here = written(values.groupBy("node", at).agg(F.sum("value").alias("value")).where("value <> 0"), "hop")
    out = here.withColumn("hop", F.lit(0))
    for hop in range(1, k + 1):
        sent = here.withColumnRenamed("node", "a").join(edges, "a").where("weight <> 0")
        here = written(sent.groupBy(F.col("b").alias("node"), at).agg(F.sum(F.col("value") * F.col("weight")).alias("value")).where("value <> 0"), "hop")
        out = out.unionByName(here.withColumn("hop", F.lit(hop)))
    return out.select("node", at, "hop", "value")


def windows(series: DataFrame, keys: list[str], at: str, value: str, lags: list[int], horizon: int, first: int, last: int) -> DataFrame:
    """(keys, at, inputs, targets) for each target slot from ``first`` to ``last``: the values at its lags, in their order, and
    those of ``horizon`` slots from it on.

    Only windows whose inputs and targets all lie in the series are given; a series is one row for each position."""
    w = Window.partitionBy(*keys).orderBy(at)
    rows = series.withColumn("inputs", F.array(*(F.lag(value, n).over(w) for n in lags))).withColumn("targets", F.array(*(F.lead(value, n).over(w) for n in range(horizon))))
    whole = ~F.exists("inputs", lambda x: x.isNull()) & ~F.exists("targets", lambda x: x.isNull())
    return rows.where(F.col(at).between(first, last) & whole).select(*keys, at, "inputs", "targets")


def batches(samples: DataFrame, at: str, nodes: list[str], size: int) -> DataFrame:
    """(batch, at, nodes, inputs, targets): samples of one slot put together, nodes in their order, slots dealt into batches of
    ``size`` by their place in time."""
    rows = F.array_sort(F.collect_list(F.struct(*nodes, "inputs", "targets")))
    slots = samples.groupBy(at).agg(rows.alias("rows"))
    place = samples.select(at).distinct().withColumn("batch", (F.row_number().over(Window.orderBy(at)) - 1).cast("int"))  # a row a slot of the series
    out = slots.join(F.broadcast(place), at)
    pick = lambda name: F.transform("rows", lambda r: r[name])
    return out.select(F.floor(F.col("batch") / size).cast("int").alias("batch"), at, F.transform("rows", lambda r: F.struct(*(r[n].alias(n) for n in nodes))).alias("nodes"), pick("inputs").alias("inputs"), pick("targets").alias("targets"))
