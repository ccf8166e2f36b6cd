"""Permutation tests of correlations within units, for many pairs of columns at once.

The statistic of a panel is the mean product of two columns that are standard scores within units, over all its rows: the
average correlation within units, weighted by their sizes.  Under the null, one column is shuffled within each unit.

Shuffles are drawn where a unit's rows are, in blocks that are seeded by (unit, block), so the same draws come out on any
cluster.  A task adds up the draws of a block over its units; what leaves it is one sum for each draw and pair, and after
the sums of all units have met, one count of exceedances for each pair.  Rows are never repeated for a draw.  A unit's rows
are one list: components of a unit, of which there are no more than slots of its series."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odresil.shipping import ship

DRAWS, BLOCK, SEED = 10_000, 500, 0
#: Sums that differ by rounding alone count as equal.
SLACK = 1e-12


def pairs_of(columns: list[str]) -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]


def shuffled_sums(values: np.ndarray, draws: int, seed: list[int], pairs) -> np.ndarray:
    """Sums [draw, pair] of products of a unit's columns [row, column], the second one shuffled alike for all pairs."""
    order = np.argsort(np.random.default_rng(seed).random((draws, len(values))), axis=1)
    return np.stack([values[:, j][order] @ values[:, i] for i, j in pairs], 1)


def permutation_test(rows: DataFrame, panel: str, unit: str, item: str, columns: list[str], draws: int = DRAWS, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(panel, a, b, n, rho, p) of every two columns; p is two-sided and null where a value is missing or rows are below three.

    The last block of draws may be shorter; ``item`` orders a unit's rows, so that draws do not depend on how they arrive."""
    ship(rows.sparkSession)
    pairs = pairs_of(columns)
    sizes = [min(block, draws - lo) for lo in range(0, draws, block)]
    some = rows.select(F.col(panel).alias("panel"), F.col(unit).alias("unit"), F.col(item).alias("_item"), *(F.col(c).cast("double").alias(c) for c in columns))
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    product = lambda i, j: F.sum(F.col(columns[i]) * F.col(columns[j])) / F.count("*")
    whole = [F.when(F.every(known(columns[i]) & known(columns[j])) & (F.count("*") >= 3), product(i, j)) for i, j in pairs]
    seen = some.groupBy("panel").agg(F.count("*").alias("n"), F.array(*whole).alias("seen"))
    lists = some.groupBy("panel", "unit").agg(F.array_sort(F.collect_list(F.struct("_item", *columns))).alias("rows"))
    tasks = lists.select("panel", "unit", F.transform("rows", lambda r: F.array(*(r[c] for c in columns))).alias("rows"), F.explode(F.sequence(F.lit(0), F.lit(len(sizes) - 1))).alias("block"))

    def draw(batches):
        sums: dict = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                values = np.array([[np.nan if x is None else x for x in row] for row in r.rows], float)
                name = zlib.crc32(str(r.unit).encode())
                part = shuffled_sums(values, sizes[r.block], [seed, int(r.block), name], pairs)
                key = r.panel, int(r.block)
                sums[key] = sums[key] + part if key in sums else part
        if sums:
            yield pd.DataFrame([(p, b, s.ravel()) for (p, b), s in sums.items()], columns=["panel", "block", "sums"])

    kind = some.schema["panel"].dataType.simpleString()
    partial = tasks.repartition("panel", "block").mapInPandas(draw, f"panel {kind}, block int, sums array<double>")

    def count(pdf):
        total = np.sum([np.asarray(s) for s in pdf["sums"]], axis=0).reshape(-1, len(pairs)) / pdf["n"].iloc[0]
        found = np.array([np.nan if x is None else x for x in pdf["seen"].iloc[0]], float)
        over = (np.abs(total) >= np.abs(found) * (1 - SLACK) - SLACK).sum(0)
        return pd.DataFrame({"panel": pdf["panel"].iloc[0], "k": range(len(pairs)), "over": over})

    counts = partial.join(seen, "panel").groupBy("panel", "block").applyInPandas(count, f"panel {kind}, k int, over long")
    p = counts.groupBy("panel", "k").agg(((F.sum("over") + 1) / F.lit(draws + 1)).alias("p"))
    cells = seen.select("panel", "n", F.posexplode("seen").alias("k", "rho")).join(p, ["panel", "k"])
    names = F.array(*(F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b")) for i, j in pairs))
    return cells.select("panel", F.get(names, F.col("k"))["a"].alias("a"), F.get(names, F.col("k"))["b"].alias("b"), "n", "rho", F.when(F.col("rho").isNotNull(), F.col("p")).alias("p"))
