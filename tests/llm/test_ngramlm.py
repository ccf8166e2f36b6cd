"""Elias-Fano sequences, the trie, and scores against a plain dictionary model."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from odresil.llm import ngramlm
from odresil.llm.ngramlm import DISCOUNT, EliasFano


@given(st.lists(st.integers(0, 2**64 - 1), max_size=60), st.lists(st.integers(0, 2**64 - 1), max_size=10))
def test_elias_fano(values, others):
    x = np.array(sorted(set(values)), np.uint64)
    ef = EliasFano.encode(x)
    assert ef.values().tolist() == x.tolist()
    wanted = np.array(values + others, np.uint64)
    assert [x[i] if i >= 0 else None for i in ef.find(wanted)] == [v if v in set(values) else None for v in values + others]


@given(st.lists(st.integers(0, 300), min_size=1, max_size=80))
def test_elias_fano_dense(values):
    x = np.array(sorted(set(values)), np.uint64)
    assert EliasFano.encode(x).values().tolist() == x.tolist()
    assert (EliasFano.encode(x).find(x) == np.arange(len(x))).all()


def brute(rows, order):
    toks = [(text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split() + ["END"] for _, text, _ in rows]
    c, V = Counter(), 0
    for t, (_, _, train) in zip(toks, rows):
        if train:
            c.update(t)
    N, V = sum(c.values()), len(c)
    tables = []
    for k in range(1, order):
        table = defaultdict(Counter)
        for t, (_, _, train) in zip(toks, rows):
            if train:
                for i in range(len(t)):
                    table[tuple((["S"] * k + t)[i : i + k])][t[i]] += 1
        tables.append(table)
    out = []
    for t in toks:
        plain = own = 0.0
        for i, w in enumerate(t):
            p = (c[w] + 1) / (N + V + 1)
            plain += math.log10(p)
            for k in range(1, order):
                seen = tables[k - 1].get(tuple((["S"] * k + t)[i : i + k]))
                if seen:
                    total = sum(seen.values())
                    p = max(seen[w] - DISCOUNT, 0) / total + DISCOUNT * len(seen) / total * p
            own += math.log10(p)
        out.append((len(t), sum(c[w] > 0 for w in t), N, plain, own))
    return out


@pytest.mark.parametrize("order,shards,size", [(2, 3, 400), (3, 4, 300), (2, 1, 10**9), (4, 7, 1000)])
def test_scores(spark, order, shards, size):
    rng = random.Random(5)
    words = ["The", "the", "of", "a", "b", "c", "é", "x y", "z"]
    rows = [(i, " ".join(rng.choices(words, [9, 9, 5, 3, 2, 1, 1, 1, 1], k=rng.randint(0, 40))), i % 4 != 0) for i in range(60)]
    rows += [(100, None, True), (101, "", False), (102, "  \n", False), (103, "unseen words only", False), (3, rows[3][1], True), (104, "the " * 500, True)]
    rows.append((None, "the of a", True))
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean").selectExpr("*", "1 as block", "'x' as data", "2 as score")
    got = ngramlm.score(df, F.col("train"), order, shards, size).collect()
    want = sorted(zip([-1 if r[0] is None else r[0] for r in rows], brute(rows, order)))
    assert len(got) == len(rows)
    got = [(r, -1 if r.doc_id is None else r.doc_id) for r in got]
    for (r, key), (doc_id, (n, known, total, plain, own)) in zip(sorted(got, key=lambda x: (x[1], x[0].n_tokens)), want):
        assert (key, r.n_tokens, r.n_known, r.train_tokens) == (doc_id, n, known, total)
        assert r.base_score == pytest.approx(plain)
        assert r.score == pytest.approx(own, rel=1e-6, abs=1e-6)


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngramlm.score(df, F.lit(True)).collect() == []
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert ngramlm.score(df, F.lit(False)).first().score == 0
