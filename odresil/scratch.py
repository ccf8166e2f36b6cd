"""Tables between steps: written into the folder that driver and executors share, and read back."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_paths: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local master gets a temporary folder and any other is refused."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("odresil.tables.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="odresil-tables-")
        spark.conf.set("odresil.tables.dir", shared)
    return shared.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    if not _paths:
        atexit.register(_clean)
    path = f"{folder(spark)}/odresil-{name}-{uuid.uuid4().hex}"
    _paths.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes what was written under ``path``."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for spark, path in _paths:
        with contextlib.suppress(Exception):  # the session may be gone already
            remove(spark, path)
        if path.startswith("file://"):
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def written(rows: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage of ``rows``: what follows reads a table, and a lost executor costs no more than its own tasks.

    The table goes when the driver ends."""
    spark = rows.sparkSession
    path = new_path(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
