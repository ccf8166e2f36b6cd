"""What the operators of this subpackage share: the shared scratch folder, splits by checksum, table reads."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch handed to Python: whole texts can be long, so batches stay short.
ARROW_ROWS = 512
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is missing, a local master gets a temporary folder; anything else is refused, as a
    machine-local folder would not be seen by the other machines.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("odresil.scratch.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="odresil-")
    spark.conf.set("odresil.scratch.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/odresil-{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes what was written under ``path``."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):  # the session may be gone already
            remove_path(spark, path)
        if path.startswith("file://"):  # a folder of this machine does not need the session
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as a table into the shared folder and reads it back.

    What was shuffled for it is dropped once it is written, so that disk holds a table or its shuffles but not both."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch = path
    return back


def ship(spark: SparkSession) -> None:
    """Gives executors this package, once for each application, so that they need no installation of it."""
    context = spark.sparkContext
    if getattr(context, "_odresil_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="odresil-")) / "odresil.zip"  # served to executors by the driver
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(str(archive))
    context._odresil_shipped = True


def small_batches(spark: SparkSession) -> None:
    """Ships the package and bounds the rows of the Arrow batches that Python workers get."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def gathered(batches, column: int, size: int):
    """Arrow batches joined until their texts in ``column`` have about ``size`` bytes: per-batch work is done less often."""
    held, held_bytes = [], 0
    for batch in batches:
        held.append(batch)
        held_bytes += batch.column(column).nbytes
        if held_bytes >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, held_bytes = [], 0
    if held and (whole := pa.Table.from_batches(held).combine_chunks().to_batches()):
        yield whole[0]


def _settle() -> None:
    """Makes this worker give freed memory back: large arrays get pages of their own, Arrow uses the same allocator.

    Workers live on between tasks, so what one stage held would else stay with the next."""
    if sys.platform == "linux" and not _settled:
        with contextlib.suppress(OSError, AttributeError):
            libc = ctypes.CDLL("libc.so.6")
            libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, fixed from now on
            _settled.append(libc)
        pa.set_memory_pool(pa.system_memory_pool())


def _trim() -> None:
    for libc in _settled:
        libc.malloc_trim(0)


_settled: list = []


def lean(run):
    """A function over batches that leaves no freed memory with its worker."""

    def wrapped(batches):
        _settle()
        yield from run(batches)
        _trim()

    return wrapped


def lean_group(run):
    """The same for a function of one group."""

    def wrapped(table: pa.Table) -> pa.Table:
        _settle()
        out = run(table)
        _trim()
        return out

    return wrapped


def lean_pair(run):
    """The same for a function of two groups."""

    def wrapped(left: pa.Table, right: pa.Table) -> pa.Table:
        _settle()
        out = run(left, right)
        _trim()
        return out

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def quantiles(rows: DataFrame, share: float, bins: int = 1 << 11) -> dict:
    """The exact quantile of ``value`` for each ``key`` of a written table (key, value), between two values in proportion.

    The range that holds the wanted rank is cut into bins until it is one value, so no task and not the driver holds more
    than ``bins`` rows a key.  Null values do not count; a key without any has no quantile."""
    rows, spark = rows.where("value is not null"), rows.sparkSession
    kind = rows.schema["key"].dataType.simpleString()
    ends = rows.groupBy("key").agg(F.count("*"), F.min("value"), F.max("value")).collect()
    at = {key: share * (n - 1) for key, n, *_ in ends}
    open_, value = {key: (int(at[key]), lo, hi) for key, _, lo, hi in ends}, {}
    while open_:
        value.update({key: lo for key, (_, lo, hi) in open_.items() if lo == hi})
        open_ = {key: x for key, x in open_.items() if key not in value}
        if not open_:
            break
        bounds = spark.createDataFrame([(key, lo, hi) for key, (_, lo, hi) in open_.items()], f"key {kind}, lo double, hi double")
        some = rows.join(F.broadcast(bounds), "key").where("value between lo and hi")
        bin_ = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
        cut = some.groupBy("key", bin_.alias("bin")).agg(F.count("*"), F.min("value"), F.max("value")).collect()
        rank = {key: x[0] for key, x in open_.items()}
        for key, _, n, lo, hi in sorted(cut, key=lambda r: r["bin"]):
            if 0 <= rank[key] < n:
                open_[key] = rank[key], lo, hi
            rank[key] -= n
    if not value:
        return {}
    found = spark.createDataFrame(list(value.items()), f"key {kind}, at double")
    above = F.min(F.when(F.col("value") > F.col("at"), F.col("value")))
    for key, upto, more in rows.join(F.broadcast(found), "key").groupBy("key").agg(F.count_if(F.col("value") <= F.col("at")), above).collect():
        part = at[key] - int(at[key])
        if part and upto < int(at[key]) + 2:
            value[key] = (1 - part) * value[key] + part * more
    return value
