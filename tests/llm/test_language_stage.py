"""The pipeline's language stage drops what is in no learned language and keeps the rest."""

import random

import pytest

import corpus_pipeline
from odresil.llm import base

FOREIGN = [
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "すべての 人間は、 生まれながらに して自由であり、 かつ、 尊厳と 権利とに ついて 平等である。 人間は、 理性と 良心とを 授けられており",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
]


@pytest.fixture(scope="module")
def clean(spark):
    """What the stage gets: the small tables hold planted shouting and symbol noise that the first stage drops."""
    sf = "/root/testdata/sf0.01"
    return base.written(corpus_pipeline.quality_stage(spark, base.table(spark, sf, "documents").select(*corpus_pipeline.COLUMNS), sf), "clean")


def test_foreign_and_gibberish_are_dropped(spark, clean):
    rng = random.Random(3)
    gibberish = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(30)) for _ in range(4)]
    docs = clean
    # the last of each kind carries a false label, so it is learned too
    extra = [(-1 - k, t, "en" if t in (FOREIGN[-1], gibberish[-1]) else None, "x", len(t)) for k, t in enumerate(FOREIGN + gibberish)]
    got = corpus_pipeline.language_stage(spark, docs.unionByName(spark.createDataFrame(extra, docs.schema)), "")
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    assert not [i for i in ids if i < 0]
    assert len(ids) == len(set(ids)) >= 0.98 * docs.count()


def test_one_language(spark, clean):
    docs = clean.where("lang = 'de'")
    extra = [(-1 - k, t, None, "x", len(t)) for k, t in enumerate(FOREIGN)]
    got = corpus_pipeline.language_stage(spark, docs.unionByName(spark.createDataFrame(extra, docs.schema)), "")
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    assert min(ids) >= 0 and len(ids) >= 0.98 * docs.count()
