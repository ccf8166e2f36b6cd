"""Non-negative factorisation of units whose matrices no task can hold: X ~ W H by coordinate descent over blocks of pairs.

A unit's matrix has a row for each slot, some hundreds, and a column for each pair of zones, any number.  Columns lie in
blocks of ``BLOCK`` pairs, a row a block, in a table bucketed by (unit, block); a block's part of H lies in a table bucketed
alike, so the join of both in each round moves nothing.  W is slots by components and goes to every task.

A round updates each block's columns of H under W, adds up H H' and X H' over all blocks, and updates W by these sums.  The
same pass writes the new H and the sums, so the large table is read once a round, and each round is a table that a lost
executor's tasks can start from.  Sweeps, order and stop rule are those of the one-task kernel ``kernels.factor.nmf``, and so
are its starting factors, here from the sum of X X' and the lengths of the signed parts of its vectors."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odresil.kernels import factor
from odresil.scratch import new_path, remove, written
from odresil.shipping import ship

#: Pairs of a block.
BLOCK = 256


def blocks(pairs: DataFrame, size: int = BLOCK) -> DataFrame:
    """(unit, block, keys, x): pairs (unit, origin, dest, series) in blocks by a hash; x holds the series one after another.

    A block has about ``size`` pairs; the order within it is that of the pairs."""
    many = pairs.groupBy("unit").agg(F.ceil(F.count("*") / size).cast("int").alias("_n"))
    dealt = pairs.join(F.broadcast(many), "unit").withColumn("block", F.pmod(F.xxhash64("origin", "dest"), F.col("_n")).cast("int"))
    rows = F.array_sort(F.collect_list(F.struct("origin", "dest", "series")))
    out = dealt.groupBy("unit", "block").agg(rows.alias("rows"))
    return out.select("unit", "block", F.transform("rows", lambda r: F.struct(r["origin"].alias("origin"), r["dest"].alias("dest"))).alias("keys"), F.flatten(F.transform("rows", lambda r: r["series"])).alias("x"))


def _added(rows: DataFrame, run, schema: str, names: tuple[str, ...]):
    """Sums over blocks: ``run`` maps a batch's row to a unit and arrays; tasks add up their own, then a task a unit the rest."""

    def partial(batches):
        sums: dict = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                parts = run(r)
                sums[r.unit] = [a + b for a, b in zip(sums[r.unit], parts)] if r.unit in sums else parts
        if sums:
            yield pd.DataFrame([(u, *(p.ravel() for p in parts)) for u, parts in sums.items()], columns=["unit", *names])

    return rows.mapInPandas(partial, schema)


def _total(pdf: pd.DataFrame, name: str) -> np.ndarray:
    return np.sum([np.asarray(v, float) for v in pdf[name]], axis=0)


class Rounds:
    """Bucketed tables of one factorisation."""

    def __init__(self, spark, buckets: int):
        self.spark, self.buckets, self.tables = spark, buckets, []

    def save(self, rows: DataFrame, what: str) -> DataFrame:
        name, path = f"odresil_{what}_{uuid.uuid4().hex}", new_path(self.spark, what)
        rows.write.bucketBy(self.buckets, "unit", "block").option("path", path).saveAsTable(name)
        self.tables.append((name, path))
        return self.spark.table(name)

    def drop(self, keep: tuple[int, ...] = ()) -> None:
        """Drops all tables, and their files, but those of some numbers."""
        kept = [self.tables[k] for k in keep]
        for name, path in self.tables:
            if (name, path) not in kept:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
                remove(self.spark, path)
        self.tables = kept


def started(x: DataFrame, slots: int, k: int) -> DataFrame:
    """(unit, u, s, length): leading vectors over slots, singular values, and lengths of the signed parts over pairs."""
    kind = x.schema["unit"].dataType.simpleString()

    def gram(r):
        m = np.asarray(r.x, float).reshape(-1, slots)
        return [m.T @ m]

    def solve(pdf):
        values, vectors = np.linalg.eigh(_total(pdf, "g").reshape(slots, slots))
        s, u = np.sqrt(np.maximum(values[::-1][:k], 0)), vectors[:, ::-1][:, :k]
        u = u * (s > 1e-12 * max(s[0], 1e-300))
        return pd.DataFrame({"unit": [pdf["unit"].iloc[0]], "u": [u.ravel()], "s": [s]})

    sums = _added(x.select("unit", "x"), gram, f"unit {kind}, g array<double>", ("g",))
    vectors = written(sums.groupBy("unit").applyInPandas(solve, f"unit {kind}, u array<double>, s array<double>"), "vectors")

    def signed(r):
        v = _right(r, slots, k)
        return [np.stack([(np.maximum(v, 0) ** 2).sum(0), (np.maximum(-v, 0) ** 2).sum(0)])]

    lengths = _added(x.select("unit", "x").join(F.broadcast(vectors), "unit"), signed, f"unit {kind}, l array<double>", ("l",))
    total = lengths.groupBy("unit").applyInPandas(lambda pdf: pd.DataFrame({"unit": [pdf["unit"].iloc[0]], "l": [_total(pdf, "l")]}), f"unit {kind}, l array<double>")
    return written(vectors.join(total, "unit"), "starts")


def _right(r, slots: int, k: int) -> np.ndarray:
    """A block's rows of the singular vectors over pairs."""
    u, s = np.asarray(r.u, float).reshape(slots, k), np.asarray(r.s, float)
    return np.asarray(r.x, float).reshape(-1, slots) @ u / np.where(s > 0, s, 1)


def _signs(u: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each component the sign of larger mass, and the lengths of both vectors' parts of that sign."""
    left = np.stack([np.sqrt((np.maximum(u, 0) ** 2).sum(0)), np.sqrt((np.maximum(-u, 0) ** 2).sum(0))])
    right = np.sqrt(lengths)
    best = (left * right).argmax(0)
    at = np.arange(u.shape[1])
    return 1.0 - 2 * best, left[best, at], right[best, at]


def nmf_blocks(pairs: DataFrame, slots: int, k: int, l1: float = 0.0, sweeps: int = 300, tol: float = 1e-4, size: int = BLOCK, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((unit, w) with w slot by slot, (unit, block, keys, h) with h pair by pair) of pairs (unit, origin, dest, series).

    Every series has ``slots`` values.  A unit whose gradient has fallen to ``tol`` of its first one keeps its factors."""
    spark = pairs.sparkSession
    ship(spark)
    kind = pairs.schema["unit"].dataType.simpleString()
    rounds = Rounds(spark, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    x = rounds.save(blocks(pairs, size), "x")
    small = x.groupBy("unit").agg(F.sum(F.size("keys")).alias("n")).where(F.least(F.col("n"), F.lit(slots)) < k)
    if small.limit(1).count():
        raise ValueError("more components than slots or pairs")
    start = started(x, slots, k)
    schema = f"unit {kind}, block int, h array<double>, gram array<double>, cross array<double>, moved double"

    def stepped(rows: DataFrame, update) -> DataFrame:
        """Each block's new H, and a row without a block for the sums of a task's blocks of a unit."""

        def run(batches):
            sums: dict = {}
            for pdf in batches:
                out = []
                for r in pdf.itertuples(index=False):
                    m = np.asarray(r.x, float).reshape(-1, slots)
                    h, moved = update(r, m)
                    parts = [h.T @ h, m.T @ h, moved]
                    sums[r.unit] = [a + b for a, b in zip(sums[r.unit], parts)] if r.unit in sums else parts
                    out.append((r.unit, r.block, h.ravel(), None, None, None))
                yield pd.DataFrame(out, columns=["unit", "block", "h", "gram", "cross", "moved"])
            if sums:
                yield pd.DataFrame([(u, -1, None, g.ravel(), c.ravel(), float(v)) for u, (g, c, v) in sums.items()], columns=["unit", "block", "h", "gram", "cross", "moved"])

        return rounds.save(rows.mapInPandas(run, schema), "h")

    def first(r, m):
        u, s = np.asarray(r.u, float).reshape(slots, k), np.asarray(r.s, float)
        sign, a, b = _signs(u, np.asarray(r.l, float).reshape(2, k))
        part = np.maximum(sign * _right(r, slots, k), 0)
        return np.where((a > 0) & (b > 0), np.sqrt(s * a * b) * part / np.where(b > 0, b, 1), 0.0), 0.0

    def opening(pdf):
        r = pdf.iloc[0]
        u, s = np.asarray(r["u"], float).reshape(slots, k), np.asarray(r["s"], float)
        sign, a, b = _signs(u, np.asarray(r["l"], float).reshape(2, k))
        w = np.where((a > 0) & (b > 0), np.sqrt(s * a * b) * np.maximum(sign * u, 0) / np.where(a > 0, a, 1), 0.0)
        return pd.DataFrame({"unit": [r["unit"]], "w": [w.ravel()], "first": [0.0], "moved": [0.0], "done": [False]})

    state = f"unit {kind}, w array<double>, first double, moved double, done boolean"

    def settle(left, right):
        """W under the sums of a round; ``moved`` holds what W moved, until the blocks' part is known."""
        r = right.iloc[0]
        total, opened = float(left["moved"].sum()) + r["moved"], float(r["first"])
        opened = opened or total
        done = bool(r["done"]) or bool(opened) and total <= tol * opened
        w, moved = np.array(r["w"], float).reshape(slots, k), 0.0
        if not done:
            moved = factor.sweep(w, _total(left, "gram").reshape(k, k), _total(left, "cross").reshape(slots, k), l1)
        return pd.DataFrame({"unit": [r["unit"]], "w": [w.ravel()], "first": [opened], "moved": [moved], "done": [done]})

    def follow(r, m):
        h = np.array(r.h, float).reshape(-1, k)
        if r.done:
            return h, 0.0
        w = np.asarray(r.w, float).reshape(slots, k)
        return h, factor.sweep(h, w.T @ w, m @ w, l1)

    h = stepped(x.join(F.broadcast(start), "unit"), first)
    w = written(start.groupBy("unit").applyInPandas(opening, state), "w")
    for _ in range(sweeps):
        sums = h.where("block = -1").select("unit", "gram", "cross", "moved")
        w = written(sums.groupBy("unit").cogroup(w.groupBy("unit")).applyInPandas(settle, state), "w")
        if not w.where("not done").limit(1).count():
            break
        both = x.select("unit", "block", "x").join(h.where("block >= 0").select("unit", "block", "h"), ["unit", "block"])
        h = stepped(both.join(F.broadcast(w.select("unit", "w", "done")), "unit"), follow)
        rounds.drop(keep=(0, -1))
    out = written(x.select("unit", "block", "keys").join(h.where("block >= 0").select("unit", "block", "h"), ["unit", "block"]), "h")
    rounds.drop()
    return w.select("unit", "w"), out


def loadings(h: DataFrame, k: int) -> DataFrame:
    """(unit, origin, dest, component, value) of the blocks of H."""
    cells = h.select("unit", F.posexplode("keys").alias("i", "key"), "h")
    return cells.select("unit", "key.origin", "key.dest", F.posexplode(F.slice("h", F.col("i") * k + 1, F.lit(k))).alias("component", "value"))


def weights(w: DataFrame, k: int) -> DataFrame:
    """(unit, slot_idx, component, value) of W."""
    cells = w.select("unit", F.posexplode("w").alias("i", "value"))
    return cells.select("unit", F.floor(F.col("i") / k).cast("int").alias("slot_idx"), F.pmod("i", F.lit(k)).alias("component"), "value")
