"""Ridge, directions and principal axes from sums of products, for any number of rows.

Each unit has a matrix of sums of products of (1, features, target); tasks add up their own rows, Spark adds up the tasks.
What is learned from some units follows from the sum of their matrices, so leaving a unit out is a subtraction.  The
leave-one-out error that chooses a ridge's penalty needs each row's leverage: a second pass over the rows, with the fits of
at most ``BLOCK`` folds in each task, adds up one number for each fold and penalty.  No group of rows ever meets in a task.

Folds are named by their unit: ``without`` it, ``within`` it, or all rows (``pooled``, whose name is null)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odresil.scratch import written
from odresil.shipping import ship

MODES = ("without", "within", "pooled")
#: Folds whose fits a task holds at a time; what is added to a deviation, so that a constant can be divided by it.
BLOCK, TINY = 256, 1e-12


def standardised(rows: DataFrame, unit: str, names: list[str]) -> DataFrame:
    """Standard scores within units by population deviation, about 0 for a constant, from one aggregation joined back."""
    sums = [f(n).alias(f"_{k}_{n}") for n in names for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    stats = rows.groupBy(F.col(unit).alias("_unit")).agg(*sums)
    score = lambda n: (F.col(n) - F.col(f"_m_{n}")) / (F.col(f"_s_{n}") + TINY)
    out = rows.join(stats, F.col(unit).eqNullSafe(F.col("_unit"))).withColumns({n: score(n) for n in names})
    return out.select(*rows.columns)


def products(rows: DataFrame, unit: str, names: list[str], target: str) -> DataFrame:
    """(unit, i, j, total): sums of products of the columns 1, names and target, by their numbers, for each unit."""
    ship(rows.sparkSession)
    columns = [F.col(n).cast("double").alias(n) for n in (*names, target)]
    kind, width = rows.schema[unit].dataType.simpleString(), len(names) + 2

    def run(batches):
        sums: dict = {}
        for batch in batches:
            z = np.column_stack([np.ones(batch.num_rows), *(np.asarray(c) for c in batch.columns[1:])])
            keys = batch.column(0).dictionary_encode()
            codes = np.asarray(keys.indices)
            for code, key in enumerate(keys.dictionary.to_pylist()):
                part = z[codes == code]
                sums[key] = sums.get(key, 0.0) + part.T @ part
        i, j = np.divmod(np.arange(width * width), width)
        for key, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(i), batch.schema.field(0).type), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], names=["unit", "i", "j", "total"])

    parts = rows.select(F.col(unit).alias("unit"), *columns).mapInArrow(run, f"unit {kind}, i int, j int, total double")
    return parts.groupBy("unit", "i", "j").agg(F.sum("total").alias("total"))


@dataclass
class Fit:
    """A fold's ridge path: centre and deviation of the features, mean of the target, axes, their eigenvalues and loads."""

    rows: float
    mean: np.ndarray
    scale: np.ndarray
    start: float
    axes: np.ndarray
    values: np.ndarray
    loads: np.ndarray

    def coefficients(self, penalty: float) -> tuple[np.ndarray, float]:
        """Coefficients of the unscaled features, and the intercept."""
        beta = self.axes @ (self.loads / (self.values + penalty)) / self.scale
        return beta, float(self.start - self.mean @ beta)

    def errors(self, x: np.ndarray, y: np.ndarray, penalties: np.ndarray) -> np.ndarray:
        """Squared leave-one-out errors of training rows, summed for each penalty."""
        z = (x - self.mean) / self.scale @ self.axes
        shrink = 1 / (self.values[:, None] + penalties)
        left = np.maximum(1 - 1 / self.rows - z**2 @ shrink, 1e-12)
        return (((y[:, None] - self.start - z @ (self.loads[:, None] * shrink)) / left) ** 2).sum(0)


def solved(sums: np.ndarray, scaled: list[int]) -> Fit:
    """The fold of a matrix of sums; features whose numbers are in ``scaled`` are divided by the fold's own deviation."""
    n, d = sums[0, 0], len(sums) - 2
    mean, start = sums[0, 1:-1] / n, sums[0, -1] / n
    centred = sums[1:-1, 1:-1] - n * np.outer(mean, mean)
    cross = sums[1:-1, -1] - n * mean * start
    scale = np.ones(d)
    for j in scaled:
        deviation = np.sqrt(max(centred[j, j], 0) / n)
        scale[j] = deviation if deviation > 1e-12 else 1.0
    values, axes = np.linalg.eigh(centred / np.outer(scale, scale))
    return Fit(n, mean, scale, start, axes, np.maximum(values, 0), axes.T @ (cross / scale))


def gathered(cells, width: int) -> dict:
    """Rows (unit, i, j, total) as a matrix for each unit."""
    out: dict = {}
    for r in cells:
        out.setdefault(r["unit"], np.zeros((width, width)))[r["i"], r["j"]] = r["total"]
    return out


def _chosen(rows: DataFrame, unit: str, names: list[str], target: str, fits: dict, mode: str, penalties: np.ndarray) -> dict:
    """The penalty of least leave-one-out error for each fold, the first of equally good ones."""
    folds = list(fits)

    def run(batches):
        sums = np.zeros((len(folds), len(penalties)))
        for batch in batches:
            units = np.array(batch.column(0).to_pylist(), object)
            x, y = np.column_stack([np.asarray(c) for c in batch.columns[1:-1]]), np.asarray(batch.columns[-1])
            for f, name in enumerate(folds):
                mine = np.ones(len(y), bool) if mode == "pooled" else (units == name) == (mode == "within")
                if mine.any():
                    sums[f] += fits[name].errors(x[mine], y[mine], penalties)
        f, p = np.divmod(np.arange(sums.size), len(penalties))
        yield pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.array(p, pa.int32()), pa.array(sums.ravel())], names=["fold", "p", "error"])

    columns = [F.col(n).cast("double").alias(n) for n in (*names, target)]
    parts = rows.select(unit, *columns).mapInArrow(run, "fold int, p int, error double")
    errors = np.zeros((len(folds), len(penalties)))
    for r in parts.groupBy("fold", "p").agg(F.sum("error").alias("error")).collect():  # a number for each fold and penalty
        errors[r["fold"], r["p"]] = r["error"]
    return {name: float(penalties[int(e.argmin())]) for name, e in zip(folds, errors)}


def ridge(rows: DataFrame, unit: str, names: list[str], target: str, penalties, mode: str, scaled: tuple[str, ...] = ()) -> DataFrame:
    """(fold, penalty, intercept, beta): ridge with the penalty of least leave-one-out error, for each fold of a mode.

    Columns in ``scaled`` are divided by the deviation of the fold's rows.  ``rows`` should be a written table: it is read
    once for the sums and once for the errors of each ``BLOCK`` folds.  Folds without rows, as of a single unit without
    itself, are left out."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    spark, width, penalties = rows.sparkSession, len(names) + 2, np.asarray(penalties, float)
    own = written(products(rows, unit, names, target), "products")
    everything = own.groupBy("i", "j").agg(F.sum("total").alias("total")).withColumn("unit", F.lit(None))
    total = gathered(everything.collect(), width).get(None)
    number = [names.index(n) for n in scaled]
    units = sorted((r["unit"] for r in own.select("unit").distinct().collect()), key=lambda u: (u is not None, u))
    out = []
    for lo in range(0, 1 if mode == "pooled" else len(units), BLOCK):
        block = units[lo : lo + BLOCK]
        if mode == "pooled":
            sums = {} if total is None else {None: total}
        else:
            sums = gathered(own.where(F.col("unit").isin([u for u in block if u is not None]) | F.col("unit").isNull()).collect(), width)
            if mode == "without":
                sums = {u: total - s for u, s in sums.items() if total[0, 0] > s[0, 0]}
        fits = {u: solved(s, number) for u, s in sums.items()}
        if fits:
            best = _chosen(rows, unit, names, target, fits, mode, penalties)
            for u, fit in fits.items():
                beta, start = fit.coefficients(best[u])
                out.append((u, best[u], start, beta.tolist()))
    kind = rows.schema[unit].dataType.simpleString()
    return spark.createDataFrame(out, f"fold {kind}, penalty double, intercept double, beta array<double>")


def scored(rows: DataFrame, unit: str, names: list[str], fits: DataFrame, name: str = "score") -> DataFrame:
    """Rows with the prediction of their own unit's fold; rows of units without a fold are left out."""
    f = fits.select(F.col("fold").alias("_fold"), F.col("intercept").alias("_start"), F.col("beta").alias("_beta"))
    value = F.array(*(F.col(n).cast("double") for n in names))
    dot = F.aggregate(F.zip_with(value, F.col("_beta"), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    out = rows.join(F.broadcast(f), F.col(unit).eqNullSafe(F.col("_fold")))  # a row a unit
    return out.withColumn(name, F.col("_start") + dot).drop("_fold", "_start", "_beta")


def axes(rows: DataFrame, unit: str, names: list[str], target: str, k: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, k principal axes as rows, their shares of the variance) of all rows; an axis' largest component is positive."""
    cells = products(rows, unit, names, target).groupBy("i", "j").agg(F.sum("total").alias("total"))
    sums = gathered(cells.withColumn("unit", F.lit(None)).collect(), len(names) + 2).get(None)
    if sums is None:
        return np.zeros(len(names)), np.zeros((0, len(names))), np.zeros(0)
    mean = sums[0, 1:-1] / sums[0, 0]
    values, vectors = np.linalg.eigh(sums[1:-1, 1:-1] - sums[0, 0] * np.outer(mean, mean))
    out = vectors.T[::-1][:k]
    out = out * np.where(out[np.arange(len(out)), np.abs(out).argmax(1)] < 0, -1, 1)[:, None]
    values = np.maximum(values, 0)
    return mean, out, values[::-1][:k] / max(values.sum(), 1e-300)


def projected(rows: DataFrame, names: list[str], mean: np.ndarray, directions: np.ndarray, to: list[str]) -> DataFrame:
    """Rows with their coordinates along some directions."""
    along = lambda axis: sum(((F.col(n) - float(m)) * float(a) for n, m, a in zip(names, mean, axis)), F.lit(0.0))
    return rows.withColumns({name: along(axis) for name, axis in zip(to, directions)})
