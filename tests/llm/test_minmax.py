"""Near-duplicates against all-pairs comparison."""

import random

import numpy as np
import pytest

from odresil.llm import minmax


def brute(rows, width=4):
    sets = []
    for _, text in rows:
        w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    label = {i: i for i, _ in rows if i is not None}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, (i, _) in enumerate(rows):
        for m in range(k):
            j, c = rows[m][0], len(sets[k] & sets[m])
            if i is not None and j is not None and c and 100 * c >= 80 * len(sets[k] | sets[m]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return sorted(((i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets)), key=repr)


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    rows, n = [], 0
    for size in (1, 3, 4, 12, 60, 150):
        start = [word() for _ in range(size)]
        pool = [start]
        for _ in range(30):
            text = list(rng.choice(pool))
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                text[rng.randrange(len(text))] = word()
            pool.append(text)
        rows += [(n + k, " ".join(t)) for k, t in enumerate(pool)]
        n += len(pool) + 5
    rows += [(990, None), (990, rows[40][1]), (2, "a text of its own"), (991, "a text of its own"), (991, "and one more text"), (992, "AND one more text")]
    rows += [(900, None), (901, ""), (902, " \n"), (903, rows[-1][1].upper()), (None, rows[0][1]), (None, "x"), (904, "one two"), (904, "one two"), (905, "One  two")]
    rng.shuffle(rows)
    return rows


def test_components(spark):
    rows = corpus()
    got = minmax.link(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "'p' as print"), width=4)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(minmax, "ASKED", 40)
    monkeypatch.setattr(minmax, "AGAINST", 90)
    monkeypatch.setattr(minmax, "SMALL", 4)
    monkeypatch.setattr(minmax, "PART", 3)
    rows = corpus(8)
    got = minmax.link(spark.createDataFrame(rows, "doc_id long, text string"), width=4)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_shared_doc_id(spark):
    p, q = "one text of several words that stands here", "another text with quite different words in it"
    rows = [(1, p), (5, p), (2, q), (5, q)]
    got = minmax.link(spark.createDataFrame(rows, "doc_id long, text string"), width=4)
    assert {r.component_id for r in got.collect()} == {1} and got.count() == 4


def test_chain_of_one_family(spark):
    """Each text links to its neighbours only; the whole chain is one component."""
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[3 * k : 3 * k + 60])) for k in range(100)]
    got = minmax.link(spark.createDataFrame(rows, "doc_id long, text string"), width=4)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_empty(spark):
    assert minmax.link(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_signatures():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    y = np.unique(np.concatenate([x[:360], rng.integers(0, 2**63, 40).astype(np.uint64)]))
    same = (minmax.signatures([x]) == minmax.signatures([y])).mean()
    assert same == pytest.approx((360 / 440) ** 4, abs=0.25)
    assert (minmax.signatures([x]) == minmax.signatures([x, y])[:1]).all()
