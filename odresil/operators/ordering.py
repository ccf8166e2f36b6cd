"""Places in a global order without a global window: ranges are sorted apart, and one count a range goes to the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odresil.scratch import written
from odresil.shipping import ship


def ranged(rows: DataFrame, *keys: str) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(the rows in ranges of the keys, with ``_part`` and the place ``_place`` in it, [(range, rows before it)]).

    Equal keys may lie in several ranges, so a key that many rows share is no hot range."""
    ship(rows.sparkSession)
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches):
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            places = pa.array(np.arange(before, before + n, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), places], names=[*batch.schema.names, "_part", "_place"])
            before += n

    out = written(dealt.mapInArrow(run, f"{fields}, _part int, _place long"), "ranges")
    starts, total = [], 0
    for part, n in sorted((r["_part"], r["count"]) for r in out.groupBy("_part").count().collect()):
        starts.append((part, total))
        total += n
    return out, starts


def numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds the 0-based place of each row in the order of the keys."""
    out, starts = ranged(rows, *keys)
    start = rows.sparkSession.createDataFrame(starts, "_part int, _start long")  # a row a range
    return out.join(F.broadcast(start), "_part").withColumn(name, F.col("_start") + F.col("_place")).drop("_part", "_place", "_start")
