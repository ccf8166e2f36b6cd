"""SimHash: fingerprints and links against plain loops, cut buckets, odd rows."""

import random
import re
import string

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from odresil.llm import simhash
from odresil.llm.queries import QUERIES

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """Least id reachable over links of at most two bits, for (id, fingerprint) rows; rows of one id are one document."""
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for k, (a, x) in enumerate(prints):
        for b, y in prints[:k]:
            if (x ^ y).bit_count() <= 2:
                up[max(top(a), top(b))] = min(top(a), top(b))
    return {a: top(a) for a, _ in prints}


def test_query_like_plain_loops(spark):
    got = QUERIES["op12_simhash_dedup"](spark, "/root/testdata/sf0.001").collect()
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    prints = [(r.doc_id, fingerprint(r.text)) for r in rows]
    want = components(prints)
    assert sorted(tuple(r) for r in got) == sorted((a, f"{x:016x}", want[a]) for a, x in prints)
    assert len(set(want.values())) < len(rows)


def test_odd_rows(spark):
    long = " ".join(random.Random(1).choices("alpha beta gamma delta".split(), k=70_000))
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "oNE"), (6, "one two"), (7, "a b c d"), (7, "other words of this id"), (8, "other words of this id"), (None, "a b c d"), (9, long), (10, "Ä ö ü ß")]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1L as print", "'x' as mask", "2 as label")
    got = {(r.doc_id, r.print % (1 << 64)): r.component_id for r in simhash.link(df).collect()}
    assert set(got) == {(a, fingerprint(t)) for a, t in texts}
    by_id = {a: c for (a, _), c in got.items()}
    assert [by_id[k] for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)] == [1, 1, 1, 4, 4, 6, 7, 7, 9, 10] and by_id[None] == 7
    assert simhash.link(df.limit(0)).collect() == []
    alone = simhash.link(spark.createDataFrame([(None, "x y z")], "doc_id long, text string")).collect()
    assert [r.component_id for r in alone] == [None]


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 300), st.integers(0, 5), st.integers(1, 6))
def test_bit_planes_like_pairs(seed, n, radius, crowds):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(3)]
    rows = sorted({(rng.randrange(crowds), rng.choice(centres) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) & simhash.FULL) for _ in range(n)})
    prints, buckets = np.array([p for _, p in rows], np.uint64), np.array([b for b, _ in rows])
    label = simhash.close_sets(prints, buckets, 0, radius)
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if buckets[i] == buckets[j] and (int(prints[i]) ^ int(prints[j])).bit_count() <= radius:
                a, b = up[i], up[j]
                if a != b:
                    up = [min(a, b) if x in (a, b) else x for x in up]
    assert label.tolist() == up


def test_cuts_lose_no_pair():
    """Any two flipped bits leave some mask of each level untouched, and the last level has 256 classes a bucket at most."""
    masks = [0]
    for free in (32, 16, 8):
        masks = sorted({c for m in masks for c in simhash.cuts(m)})
        assert all(64 - m.bit_count() == free for m in masks)
        assert all(any(not (m >> a & 1 or m >> b & 1) for m in masks) for a in range(64) for b in range(a))


@pytest.mark.parametrize("crowd", [2, 8])
def test_crowded_buckets_are_cut(spark, monkeypatch, crowd):
    """Links are the same however small the buckets must be."""
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(4)]
    prints = sorted({rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(400)})
    classes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print long")
    monkeypatch.setattr(simhash, "CROWD", crowd)
    tables = simhash.close_links(classes)
    assert len(tables) == 3
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for t in tables for r in t.collect()]
    assert all((a ^ b) != 0 for a, b in links)
    up = {p: p for p in prints}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(top(a), top(b))] = min(top(a), top(b))
    want = components([(p, p) for p in prints])
    assert {p: top(p) for p in prints} == want and len(set(want.values())) > 4


def test_fingerprint_equals_the_column_function(spark):
    """Spark's own xxhash64 has the same seed: one shingle's bits are its hash."""
    row = spark.createDataFrame([("a b c",)], "text string").select(F.xxhash64("text").alias("h")).first()
    assert fingerprint("A  b\tc") == row.h % (1 << 64)
