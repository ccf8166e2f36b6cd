"""Statistics: ranks, correlations, scaling, neighbours, ECDF distances, false-discovery control, weighted quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odresil.operators.ordering import ranged
from odresil.scratch import written


def average_rank(value: str, by: list[str]) -> Column:
    """1-based rank within ``by``, ties sharing their mean rank; null values have none."""
    w = Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last())
    ties = Window.partitionBy(*by, value)
    return F.when(F.col(value).isNotNull(), F.rank().over(w) + (F.count("*").over(ties) - 1) / F.lit(2.0))


def rank_share(value: str, by: list[str]) -> Column:
    """(rank - 0.5) / rows of the group, rows without a value counted."""
    return (average_rank(value, by) - 0.5) / F.count("*").over(Window.partitionBy(*by))


def z_within(value: str, by: list[str]) -> Column:
    """Standard score within the group by population deviation; a constant group has scores 0."""
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(value).over(w)
    return (F.col(value) - F.avg(value).over(w)) / F.when(sd > 0, sd).otherwise(1.0)


def rho_of(x: str, y: str) -> Column:
    """Correlation as an aggregate; null, not an error, where one side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(long: DataFrame, item: list[str], name: str, value: str, ranks: bool) -> DataFrame:
    """(a, b, n, rho) of every two named series over their common items; null below three items or for a constant one."""
    rows = long.where(F.col(value).isNotNull()).select(*item, F.col(name).alias("name"), F.col(value).alias("value"))
    pairs = rows.select(*item, F.col("name").alias("a"), F.col("value").alias("x")).join(rows.select(*item, F.col("name").alias("b"), F.col("value").alias("y")), item)
    if ranks:  # ranks are taken over the common items of each pair
        pairs = pairs.withColumn("x", average_rank("x", ["a", "b"])).withColumn("y", average_rank("y", ["a", "b"]))
    rho = F.when(F.count("*") >= 3, rho_of("x", "y"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), rho.alias("rho"))


def correlation(rows: DataFrame, by: list[str], x: str, y: str, method: str = "spearman") -> DataFrame:
    """(by, n, rho) over the rows that have both values; null below three of them or where one is constant."""
    if method not in ("spearman", "pearson"):
        raise ValueError(f"no such correlation: {method!r}")
    some = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
    if method == "spearman":
        some = some.withColumns({"_x": average_rank("_x", by), "_y": average_rank("_y", by)})
    rho = F.when(F.count("*") >= 3, rho_of("_x", "_y"))
    return some.groupBy(*by).agg(F.count("*").alias("n"), rho.alias("rho"))


def with_p_values(rows: DataFrame) -> DataFrame:
    """Adds ``p``, two-sided under a t-distribution with n - 2 degrees, to rows with n and rho; null where rho is."""
    from odresil.kernels.solve import student_p
    from odresil.shipping import ship

    ship(rows.sparkSession)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches):
        for pdf in batches:
            pairs = zip(pdf["rho"].astype(float), pdf["n"])
            yield pdf.assign(p=[student_p(r, int(n)) if r == r and n > 2 else None for r, n in pairs])

    return rows.mapInPandas(run, f"{schema}, p double")


#: Training rows up to which ``cosine_knn`` pairs every row with all of them.
PAIRED_ROWS = 5_000


def cosine_knn(train: DataFrame, test: DataFrame, leave_one_out: bool = False) -> DataFrame:
    """(id, pred): mean of the training labels weighted by clipped cosine; the plain mean where all weights are zero.

    train: (id, v array, y); test: (id, v array).  Training rows without a label or a vector are left out; a test row without
    a vector gets the plain mean.  A training side of more than ``PAIRED_ROWS`` rows goes by blocks."""
    train = train.where(F.col("y").isNotNull() & F.col("v").isNotNull()).select("id", "v", "y")
    if train.limit(PAIRED_ROWS + 1).count() > PAIRED_ROWS:
        return cosine_knn_blocks(train, test, leave_one_out)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda a: F.sqrt(dot(a, a))
    t = train.select(F.col("id").alias("tid"), F.col("v").alias("tv"), "y")
    rows = test.select("id", "v").join(F.broadcast(t), F.col("id") != F.col("tid") if leave_one_out else F.lit(True))
    w = F.greatest(F.coalesce(F.try_divide(dot("v", "tv"), norm("v") * norm("tv")), F.lit(0.0)), F.lit(0.0))
    return rows.withColumn("w", w).groupBy("id").agg(F.coalesce(F.try_divide(F.sum(F.col("w") * F.col("y")), F.sum("w")), F.avg("y")).alias("pred"))


def packed(rows: DataFrame, size: int, width: int) -> DataFrame:
    """(at, ids, unit, y): rows (id, v, y) as written blocks of at most ``size`` unit vectors of ``width`` numbers; ``at``
    numbers the blocks.

    Blocks hold the rows of one partition each; a null vector is all zeros."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        held, n = [], 0

        def block(part):
            v = part.column("v").combine_chunks()
            x = np.zeros((part.num_rows, width))
            flat = np.asarray(v.flatten().cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False), float)
            there = np.asarray(v.is_valid())
            x[there] = flat.reshape(int(there.sum()), x.shape[1])
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            unit = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
            sides = part.column("id").to_numpy().astype(np.int64), unit, part.column("y").to_numpy().astype(float)
            return pa.RecordBatch.from_arrays([pa.array([s.tobytes()], pa.binary()) for s in sides], names=["ids", "unit", "y"])

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            n += batch.num_rows
            while n >= size:
                whole = pa.concat_tables(held)
                yield block(whole.slice(0, size))
                held, n = [whole.slice(size)], n - size
        if n:
            yield block(pa.concat_tables(held))

    blocks = rows.select(F.col("id").cast("long").alias("id"), "v", F.col("y").cast("double").alias("y")).mapInArrow(run, "ids binary, unit binary, y binary")
    return written(blocks.withColumn("at", F.monotonically_increasing_id()), "blocks")


def cosine_knn_blocks(train: DataFrame, test: DataFrame, leave_one_out: bool = False, size: int = 2000) -> DataFrame:
    """``cosine_knn`` for a training side of any size: every block of ``size`` unit vectors meets every other.

    Blocks are written once and pairs of them are read from the table, so nothing but partial sums is shuffled: those that a
    task has added up, a row for each test row and partition of the training side.  Training rows without a label or a vector
    are left out; a test row without a vector gets the plain mean."""
    import numpy as np
    import pyarrow as pa

    train = train.where(F.col("y").isNotNull() & F.col("v").isNotNull()).select("id", "v", "y")
    width = max(0, train.select("v").unionAll(test.select("v")).agg(F.max(F.size("v"))).first()[0] or 0)
    left = packed(test.select("id", "v", F.lit(0.0).alias("y")), size, width).drop("y")
    right = packed(train, size, width).select(F.col("ids").alias("tids"), F.col("unit").alias("tunit"), "y")

    def run(batches):
        sums: dict[int, tuple] = {}
        for batch in batches:
            for at, ids, unit, tids, tunit, y in zip(*(batch.column(k).to_pylist() for k in range(6))):
                ids, tids, y = np.frombuffer(ids, np.int64), np.frombuffer(tids, np.int64), np.frombuffer(y)
                a, b = np.frombuffer(unit).reshape(len(ids), width), np.frombuffer(tunit).reshape(len(tids), width)
                w = np.maximum(a @ b.T, 0)
                use = ids[:, None] != tids[None] if leave_one_out else np.ones(w.shape, bool)
                w = w * use
                new = np.stack([w.sum(1), w @ y, use.sum(1), use @ y])
                sums[at] = ids, sums[at][1] + new if at in sums else new
        for ids, (w, wy, n, total) in sums.values():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, w, wy, n.astype(np.int64), total)], names=["id", "w", "wy", "n", "y"])

    pairs = left.select("at", "ids", "unit").crossJoin(right)
    total = pairs.mapInArrow(run, "id long, w double, wy double, n long, y double").groupBy("id").agg(*[F.sum(c).alias(c) for c in ("w", "wy", "n", "y")])
    return total.select("id", F.coalesce(F.try_divide("wy", "w"), F.try_divide("y", "n")).alias("pred"))


def ks_distance(rows: DataFrame, by: list[str], value: str, first: str) -> DataFrame:
    """Largest gap between the right-continuous ECDFs of the rows with and without ``first``, within each group."""
    w = Window.partitionBy(*by).orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    a, b = F.col(first).cast("double"), (~F.col(first)).cast("double")
    gap = F.abs(F.try_divide(F.sum(a).over(w), F.sum(a).over(whole)) - F.try_divide(F.sum(b).over(w), F.sum(b).over(whole)))
    return rows.withColumn("gap", gap).groupBy(*by).agg(F.max("gap").alias("ks"))


def bh_adjust(rows: DataFrame, p: str) -> DataFrame:
    """``q``: Benjamini-Hochberg step-up values; missing p-values stay out.

    Rows are sorted in ranges; each range has its own running least value from above, and the driver carries one number a
    range to those below it."""
    some, starts = ranged(rows.where(F.col(p).isNotNull() & ~F.isnan(p)), p)
    start = rows.sparkSession.createDataFrame(starts, "_part int, _start long")
    total = some.agg(F.count("*").alias("_m"))  # one row
    scaled = some.join(F.broadcast(start), "_part").crossJoin(F.broadcast(total))
    scaled = scaled.withColumn("_s", F.col(p) * F.col("_m") / (F.col("_start") + F.col("_place") + 1))
    above, least = [], None
    for r in sorted(scaled.groupBy("_part").agg(F.min("_s").alias("_s")).collect(), key=lambda r: -r["_part"]):
        above.append((r["_part"], least))
        least = r["_s"] if least is None else min(least, r["_s"])
    later = rows.sparkSession.createDataFrame(above, "_part int, _above double")
    down = Window.partitionBy("_part").orderBy(F.desc("_place"))  # one range
    out = scaled.withColumn("_own", F.min("_s").over(down)).join(F.broadcast(later), "_part")
    q = F.least(F.lit(1.0), F.col("_own"), F.col("_above"))
    return out.withColumn("q", q).drop("_part", "_place", "_start", "_m", "_s", "_own", "_above")


def weighted_spearman(rows: DataFrame, by: list[str], x: str, y: str, weight: str) -> DataFrame:
    """Weighted Pearson correlation of average ranks."""
    r = rows.withColumn("_x", average_rank(x, by)).withColumn("_y", average_rank(y, by))
    s = lambda e: F.sum(F.col(weight) * e)
    m = r.groupBy(*by).agg(F.sum(weight).alias("w"), s(F.col("_x")).alias("sx"), s(F.col("_y")).alias("sy"), s(F.col("_x") * F.col("_x")).alias("sxx"), s(F.col("_y") * F.col("_y")).alias("syy"), s(F.col("_x") * F.col("_y")).alias("sxy"))
    cov, vx, vy = F.expr("sxy / w - sx * sy / (w * w)"), F.expr("sxx / w - sx * sx / (w * w)"), F.expr("syy / w - sy * sy / (w * w)")
    return m.select(*by, F.try_divide(cov, F.sqrt(vx * vy)).alias("rho"))


def weighted_quantile(rows: DataFrame, by: list[str], value: str, weight: str, p: float) -> DataFrame:
    """Linear interpolation of the values over their mid-cumulative weight shares, clamped at both ends."""
    w = Window.partitionBy(*by).orderBy(value, weight)
    c = rows.withColumn("_c", (F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight) / 2) / F.sum(weight).over(Window.partitionBy(*by)))
    lo, hi = F.max(F.when(F.col("_c") <= p, F.struct("_c", value))), F.min(F.when(F.col("_c") >= p, F.struct("_c", value)))
    e = c.groupBy(*by).agg(lo.alias("lo"), hi.alias("hi"))
    a, b = F.col(f"lo.{value}"), F.col(f"hi.{value}")
    between = a + (b - a) * F.coalesce(F.try_divide(p - F.col("lo._c"), F.col("hi._c") - F.col("lo._c")), F.lit(0.0))
    return e.select(*by, F.when(F.col("lo").isNull(), b).when(F.col("hi").isNull(), a).otherwise(between).alias("q"))
