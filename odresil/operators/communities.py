"""Communities of units over a sweep of resolutions and seeds, each (resolution, seed) a task of its own."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odresil.kernels import graph
from odresil.shipping import ship

#: Resolutions of the sweep, seeds of each, and the resolution where the sweep shows no gap (fixed values).
RESOLUTIONS = (0.5, 0.8, 1.0, 1.1, 1.2, 1.3, 1.4, 1.5, 1.7, 2.0, 3.0, 5.0)
SEEDS, FALLBACK = 40, 1.2


def affinity(pairs: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """(a, b, weight), a < b: both directions' weights, negative and missing ones counting as none, halved and added up."""
    w = F.greatest(F.coalesce(F.nanvl(F.col(weight), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)) / 2
    some = pairs.where(F.col(a) != F.col(b))
    return some.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.sum(w).alias("weight"))


def partitions(units: DataFrame, edges: DataFrame, resolutions=RESOLUTIONS, seeds: int = SEEDS) -> DataFrame:
    """(gamma, seed, unit, block, modularity): a partition of the units for each resolution and seed.

    The graph, of a few dozen units, goes to every task as one row."""
    spark = edges.sparkSession
    ship(spark)
    names = units.agg(F.array_sort(F.collect_set("unit")).alias("units"))
    whole = edges.agg(F.collect_list(F.struct("a", "b", "weight")).alias("edges")).crossJoin(names)  # one row each
    grid = spark.createDataFrame([(float(g),) for g in resolutions], "gamma double").withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    grid = grid.repartition(4 * spark.sparkContext.defaultParallelism, "gamma", "seed").crossJoin(F.broadcast(whole))
    kind = units.schema["unit"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                at = {u: k for k, u in enumerate(r.units)}
                a = np.zeros((len(at), len(at)))
                for e in r.edges:
                    a[at[e["a"]], at[e["b"]]] = a[at[e["b"]], at[e["a"]]] = e["weight"]
                label = graph.louvain(a, r.gamma, int(r.seed))
                yield pd.DataFrame({"gamma": r.gamma, "seed": r.seed, "unit": list(r.units), "block": label, "modularity": graph.modularity(a, label, r.gamma)})

    return grid.mapInPandas(run, f"gamma double, seed int, unit {kind}, block int, modularity double")


def sweep(found: DataFrame) -> DataFrame:
    """(gamma, blocks, sizes, modularity, distinct, agreement) of each resolution.

    ``distinct`` counts different partitions over the seeds, ``agreement`` is the mean share of pairs of units on which a seed
    agrees with the first; the other columns are of the first seed."""
    whole = found.groupBy("gamma", "seed").agg(F.array_sort(F.collect_list(F.struct("unit", "block"))).alias("p"), F.first("modularity").alias("modularity"))
    first = whole.where("seed = 0").select("gamma", F.col("p").alias("q"), F.col("modularity").alias("_m"))
    rows = whole.join(F.broadcast(first), "gamma")  # a row a resolution
    index = F.sequence(F.lit(0), F.size("p") - 1)
    same = lambda v, i, j: F.get(v, i)["block"] == F.get(v, j)["block"]
    equal = F.aggregate(index, F.lit(0.0), lambda s, i: s + F.aggregate(index, F.lit(0.0), lambda t, j: t + F.when((i < j) & (same("p", i, j) == same("q", i, j)), 1.0).otherwise(0.0)))
    rows = rows.withColumn("_agree", F.try_divide(equal, F.size("p") * (F.size("p") - 1) / 2))
    blocks = F.transform("q", lambda x: x["block"])
    count = lambda b: F.size(F.filter(blocks, lambda x: x == b))
    rows = rows.withColumn("_sizes", F.reverse(F.array_sort(F.transform(F.array_distinct(blocks), count))))
    out = rows.groupBy("gamma").agg(F.first("_sizes").alias("sizes"), F.first("_m").alias("modularity"), F.countDistinct("p").cast("int").alias("distinct"), F.avg("_agree").alias("agreement"))
    return out.select("gamma", F.size("sizes").alias("blocks"), "sizes", "modularity", "distinct", "agreement")


def chosen(table: DataFrame) -> DataFrame:
    """One row, gamma: the least resolution above all those with two groups or fewer and below all with five or more."""
    low = F.coalesce(F.max(F.when(F.col("blocks") <= 2, F.col("gamma"))), F.min("gamma")).alias("low")
    high = F.coalesce(F.min(F.when(F.col("blocks") >= 5, F.col("gamma"))), F.max("gamma")).alias("high")
    rows = table.select("gamma").crossJoin(F.broadcast(table.agg(low, high)))  # one row
    return rows.agg(F.coalesce(F.min(F.when((F.col("gamma") > F.col("low")) & (F.col("gamma") < F.col("high")), F.col("gamma"))), F.lit(FALLBACK)).alias("gamma"))
