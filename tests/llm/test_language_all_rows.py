"""Language trees and limits come from every labelled row, however many there are of a language."""

import collections

import numpy as np
from pyspark.sql import functions as F

from odresil.llm import ppm


def test_every_row_is_counted(spark, monkeypatch):
    docs = spark.range(7001).select(F.col("id").alias("doc_id"), F.expr("concat('w', id)").alias("text"), F.expr("if(id < 7000, 'en', 'de')").alias("lang"))
    rows = ppm.labelled(docs, F.lit(True))
    assert rows.count() == 7001
    want = collections.Counter()
    for k in range(7000):
        b = ppm.PAD + f"w{k}".encode() + ppm.PAD
        want.update(int.from_bytes(b[i : i + 4], "big") for i in range(len(b) - 3))
    for held in (ppm.HELD, 40):  # handed on once, and again and again
        monkeypatch.setattr(ppm, "HELD", held)
        got = {r.gram: r.n for r in ppm.count_grams(rows.where("lang = 'en'").repartition(3)).collect()}
        assert got == want
    assert ppm.train(docs, F.lit(True)).langs == ["de", "en"]


def test_limits_are_medians_of_all_rows(spark):
    texts = ["the cat sat on the mat " * (1 + k % 3) + str(k) for k in range(3500)] + ["der hund lag auf dem sofa " * (1 + k % 2) + str(k) for k in range(9)]
    docs = spark.createDataFrame([(k, t, "en" if k < 3500 else "de") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = ppm.train(docs, F.col("doc_id") % 5 == 0)
    rate = model.bits([t.encode() for t in texts]) / np.array([len(t) for t in texts])[:, None]
    de, en = rate[3500:], rate[:3500]
    own = {"de": np.median(de[:, 0]), "en": np.median(en[:, 1])}
    other = {"de": np.median(de[:, 1]), "en": np.median(en[:, 0])}
    foreign, got = sum(other.values()) / 2, ppm.limits(docs, model)
    for lang in ("de", "en"):
        assert np.allclose(got[lang], ((own[lang] + max(foreign, other[lang])) / 2, ppm.NARROW * (other[lang] - own[lang])), rtol=1e-6)
