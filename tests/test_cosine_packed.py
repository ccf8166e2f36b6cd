"""Blocks of unit vectors are written once; pairs of them are read, not dealt."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from odresil.operators import stats


def test_blocks_hold_every_row_once(spark):
    rows = [(k, None if k % 7 == 3 else [3.0 * k, 4.0 * k], float(k)) for k in range(25)]
    got = stats.packed(spark.createDataFrame(rows, "id long, v array<float>, y double").coalesce(1), 4, 2).collect()
    ids = [i for b in got for i in np.frombuffer(b.ids, np.int64).tolist()]
    assert sorted(ids) == list(range(25)) and len({b.at for b in got}) == len(got) == 7
    unit = np.concatenate([np.frombuffer(b.unit).reshape(-1, 2) for b in got])
    assert unit == pytest.approx(np.array([[0.0, 0.0] if k % 7 == 3 or k == 0 else [0.6, 0.8] for k in ids]))
    assert [y for b in got for y in np.frombuffer(b.y).tolist()] == ids


def test_only_sums_are_shuffled(spark):
    v = spark.range(100).select("id", F.array(F.lit(1.0), F.col("id") * 1.0).alias("v"), F.lit(1.0).alias("y"))
    plan = stats.cosine_knn_blocks(v, v, size=10)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and plan.count("Exchange hashpartitioning") == 1
    none = stats.cosine_knn_blocks(v.where("id < 0"), v, size=10)
    assert none.count() == 0
