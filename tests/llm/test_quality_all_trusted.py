"""Every trusted id counts, whatever their number, and quantiles are exact without one task that sees all values."""

import random

import pytest
from pyspark.sql import functions as F

from odresil.llm import base, quality


def test_no_trusted_id_is_left_out(spark):
    labels = spark.range(-5, 30_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert quality.trusted_ids(labels).count() == 30_005
    docs = spark.createDataFrame([(k, "some words") for k in (-6, -5, -1, 0, 63, 64, 29_999, 30_000, 1 << 40)] + [(None, "x")], "doc_id long, text string")
    got = {r.doc_id: r._id for r in quality.marked(docs, quality.trusted_ids(labels), "left").collect()}
    assert got == {k: k if k is not None and -5 <= k < 30_000 else None for k in got} and len(got) == 10
    # one bucket: the target counts are those of all trusted documents
    many = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("word").alias("text"))
    assert [(r.k, r.n) for r in quality.bucket_counts(many, quality.trusted_ids(labels), 1).collect()] == [(0, 30_000)]


@pytest.mark.parametrize("share", [0.0, 0.002, 0.5, 1.0])
def test_quantiles_like_percentile(spark, share):
    rng = random.Random(5)
    rows = [("a", rng.gauss(0, 1e-9)) for _ in range(2001)] + [("b", float(rng.randrange(4))) for _ in range(500)] + [("c", 7.0), ("d", 1.0), ("d", 2.0), ("e", None)]
    rows += [("f", 1e300), ("f", -1e-300), ("f", 0.0), ("f", 5e-324)]
    table = base.written(spark.createDataFrame(rows, "key string, value double"), "values")
    want = {r.key: r.q for r in table.groupBy("key").agg(F.percentile("value", F.lit(share)).alias("q")).collect() if r.q is not None}
    assert base.quantiles(table, share, bins=8) == pytest.approx(want, rel=1e-12, abs=0)
    assert base.quantiles(table.limit(0), share) == {}


def test_one_pass_agrees_with_fit_and_judge(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (base.table(spark, sf, t) for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    key = lambda rows: sorted(map(tuple, rows.select("doc_id", "n_words", "llr", "kept").collect()))
    assert key(quality.fit_and_judge(docs, labels)) == key(quality.judge(docs, *quality.fit(docs, labels), quality.FOLDS))
