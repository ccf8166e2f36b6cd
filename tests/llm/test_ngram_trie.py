"""The registered order and the way from a level of the trie to the next."""

import inspect
import math

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from odresil.llm import base, ngramlm
from tests.llm.test_ngramlm import brute


def test_query_uses_two_words_of_context():
    assert inspect.signature(ngramlm.score).parameters["order"].default >= 3


def test_levels_follow_the_pointers_of_the_one_above():
    b = ngramlm.WORD_BITS
    nodes = np.array([(0 << b) | 5, (0 << b) | 9, (2 << b) | 5], np.uint64)
    level = ngramlm.TrieLevel(3, nodes, np.array([4, 1, 2]))
    assert level.pointers.values().tolist() == [0, 2, 2, 3]
    places = level.query(np.array([0, 1, 2, 2, -1]), np.array([9, 5, 5, 9, 5], np.uint64))
    assert places.tolist() == [1, -1, 2, -1, -1]
    below = ngramlm.TrieLevel(3, np.array([(1 << b) | 7, (2 << b) | 7], np.uint64), np.array([1, 6]))
    assert below.query(places, np.full(5, 7, np.uint64)).tolist() == [0, -1, 1, -1, -1]
    codes, (total, kinds) = below.answer(np.array([0, -1, 1])), below.context(np.array([0, 1, 2, -1]))
    assert (codes > 0).tolist() == [True, False, True] and total.tolist() == [0, 1, 6, 0] and kinds.tolist() == [0, 1, 1, 0]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_split_contexts_change_no_score(order):
    rows = [(i, t, i != 2) for i, t in enumerate(["a b c a b d a b", "a b a b a b e", "b a b c", "", "a"])]
    texts, train = pa.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    block = ngramlm.Block.of(texts)
    roots, levels = block.levels(order - 1)
    hashes, everything = ngramlm.mixed(roots), {}
    for k in range(order - 1):
        everything |= {int(h): 2 + k for h in hashes}
        if k < len(levels):
            hashes = ngramlm.mixed(hashes[levels[k][0]] * ngramlm.ODD + roots[levels[k][1]])
    seen = []
    for shards, parts in ((1, {}), (5, {}), (5, everything)):
        common = (roots >> np.uint64(64 - ngramlm.WORD_BITS))[: len(seen)]
        asked = {s: ngramlm.answers([(0, data)], order, common) for s, data in ngramlm.questions(block, train, order, shards, parts, common)}
        tokens, kinds = (sum(a[k] for a in asked.values()) for k in (1, 2))
        got = ngramlm.scores(block, [(s, a[0][0]) for s, a in asked.items()], order, shards, parts, tokens, kinds)
        for k, want in enumerate(brute(rows, order)):
            assert (got[0][k], got[1][k], tokens) == want[:3]
            assert got[2][k] == pytest.approx(want[3]) and math.isclose(got[3][k], want[4], rel_tol=1e-9, abs_tol=1e-9)
        seen.append(got[3].tolist())
    assert seen[0] == seen[1] == seen[2]


def test_grid():
    counts = np.array([0, 1, 2, 4096, 4097, 10**6, 10**12])
    values = ngramlm.from_grid(ngramlm.to_grid(counts))
    assert values[:4].tolist() == [0, 0.25, 1.25, 4095.25] and values[4:] == pytest.approx(counts[4:] - ngramlm.DISCOUNT, rel=4e-4)


@pytest.mark.parametrize("shards,block", [(1, 10**9), (6, 20_000), (20, 3_000)])
def test_layout_changes_no_score(spark, shards, block):
    """Identical scores, to the last bit, for any numbers of blocks and shards."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    found = ngramlm.score(docs, base.fold(F.col("doc_id"), 7) != 2, shards=shards, block=block)
    key = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score.hex(), r.score.hex()) for r in found.collect())
    assert len(key) == docs.count() and LAYOUT.setdefault("key", key) == key


LAYOUT: dict = {}
