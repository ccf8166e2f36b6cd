"""Vector codes: the search against plain loops, the whole query's steps against plain loops, odd rows."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from odresil.llm import pqcodes

SCHEMA = "vec_id long, embedding array<float>, label int"


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 5), st.integers(1, 70), st.integers(0, 40), st.integers(0, 10**6), st.sampled_from([1, 3, 200, 10**6]))
def test_search_is_exact_with_ties(d, k, n, seed, spread):
    rng = np.random.default_rng(seed)
    book, x = rng.integers(-spread, spread + 1, (k, d)), rng.integers(-spread, spread + 1, (n, d))
    index, far = pqcodes.nearest(x, book)
    for row, i, f in zip(x.tolist(), index.tolist(), far.tolist()):
        all_far = [sum((a - b) ** 2 for a, b in zip(row, e)) for e in book.tolist()]
        assert f == min(all_far) and i == all_far.index(f)


def brute(rows):
    """The contract in plain loops: (code, error, label_error) by vec_id and components, and the codebooks' digest."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = [(r[0], [math.floor(256 * float(np.float32(x))) for x in r[1]], r[2]) for r in kept]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(whole[0][1]) // 16
    parts = [[r[1][p * size : (p + 1) * size] for p in range(16)] for r in whole]
    books = [[parts[k][p] for k in range(min(64, len(parts)))] for p in range(16)]

    def assign(p, w):
        far = [sum((a - b) ** 2 for a, b in zip(w, e)) for e in books[p]]
        return far.index(min(far)), min(far)

    for _ in range(2):
        for p in range(16):
            members = {}
            for r in parts:
                members.setdefault(assign(p, r[p])[0], []).append(r[p])
            books[p] = [[sum(c) // len(members[e]) for c in zip(*members[e])] if e in members else old for e, old in enumerate(books[p])]
    coded = [[assign(p, r[p]) for p in range(16)] for r in parts]
    errors = [sum(f for _, f in c) for c in coded]
    by_label = {}
    for r, e in zip(whole, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((r[0] if r[0] is not None else -1, "".join(f"{i:02x}" for i, _ in c), e, by_label[r[2]]) for r, c, e in zip(whole, coded, errors)), digest


def test_codes_like_plain_loops(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(int(k), [float(np.float32(x)) for x in rng.normal(0, 0.3, 32)], int(k) % 3 if k % 7 else None) for k in rng.permutation(150)]
    rows += [(3, None, 1), (4, [0.5] * 31 + [None], 1), (5, [math.nan] + [0.0] * 31, 1), (6, [math.inf] + [0.0] * 31, 2)]
    rows += [(9, rows[0][1], 0), (9, rows[0][1], 0), (None, rows[1][1], None)]  # repeated rows, no id
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as code", "1L as error", "2 as v", "0 as _label")
    want, digest = brute(rows)
    for few in (pqcodes.FEW_LABELS, 1):  # sums of labels broadcast, and shuffled
        monkeypatch.setattr(pqcodes, "FEW_LABELS", few)
        codes, books = pqcodes.compress(df)
        assert sorted((r.vec_id if r.vec_id is not None else -1, r.code, r.error, r.label_error) for r in codes.collect()) == want
        assert pqcodes.digest(books) == digest
    row = codes.first()
    assert len(pqcodes.decoded(row.code, books)) == 32


def test_odd_tables(spark):
    for rows in ([], [(1, None, 0)], [(1, [math.nan] * 16, 0)]):
        codes, books = pqcodes.compress(spark.createDataFrame(rows, SCHEMA))
        assert codes.collect() == [] and books.size == 0
    one, _ = pqcodes.compress(spark.createDataFrame([(1, [1.0] * 16, None)], SCHEMA))
    assert [(r.code, r.error, r.label_error) for r in one.collect()] == [("00" * 16, 0, 0)]
    short = spark.createDataFrame([(1, [0.5] * 20, 0), (2, [], 0), (3, [0.5], 0)], SCHEMA)
    codes, books = pqcodes.compress(short)
    assert books.shape == (16, 3, 2) and sorted(r.vec_id for r in codes.collect()) == [1, 2, 3]
    exact = {r.vec_id: pqcodes.decoded(r.code, books) for r in codes.where(F.col("error") == 0).collect()}
    assert exact[1][:20] == [128] * 20 and set(exact[1][20:]) == {0}
    with pytest.raises(Exception, match="do not fit 64 bits"):
        pqcodes.compress(spark.createDataFrame([(1, [1e30] * 16, 0)], SCHEMA))[0].collect()
