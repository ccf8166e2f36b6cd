"""The pipeline on the smallest tables: every stage filters, and the last packs what is left."""

import corpus_pipeline
from odresil.llm import base


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = base.table(spark, sf, "documents").select(*corpus_pipeline.COLUMNS)
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = base.written(stage(spark, docs, sf), name)
        assert docs.columns == corpus_pipeline.COLUMNS
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.4 * sizes[0]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.select("doc_id").distinct().count() == docs.count()


def rows(spark, texts):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in texts], schema)


def test_near_duplicates_keep_one_row_of_each_group(spark):
    long = " ".join(f"word{k}" for k in range(60))
    near = long.replace("word30", "other")
    texts = [(None, long, "en"), (1, near, "en"), (1, "a text that resembles no other one here", "en"), (2, long, None), (None, None, None), (3, "", "en"), (None, near, "de")]
    got = corpus_pipeline.dedup_stage(spark, rows(spark, texts), "")
    left = [r.text for r in got.collect()]
    assert got.columns == corpus_pipeline.COLUMNS
    assert sum(t in (long, near) for t in left) == 1 and sorted(t or "-" for t in left if t not in (long, near)) == ["-", "-", texts[2][1]]


def test_empty_and_odd_rows_pass_through_every_stage(spark):
    sf = "/root/testdata/sf0.001"
    some = spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.COLUMNS).limit(40)
    odd = rows(spark, [(None, None, None), (None, "", "en"), (5, " \n ", None), (5, "x", "zz"), (None, "one two " * 20_000, "en")])
    for docs in (some.limit(0), some.unionByName(odd).withColumn("TEXT2", base.F.lit(1)), odd):
        docs = base.written(docs, "odd")
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == corpus_pipeline.COLUMNS, name
            assert out.count() <= n
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).where("start = 0").count() == n
