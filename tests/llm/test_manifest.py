"""Merkle manifest: every row against plain trees, several tiers, odd rows."""

import hashlib
import string
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from odresil.llm import manifest

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes, at):
    """The siblings of node ``at`` level by level, and the last node."""
    steps = []
    while len(nodes) > 1:
        lo = at // 16 * 16
        steps.append((nodes[lo:at], nodes[at + 1 : lo + 16]))
        nodes, at = [digest(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)], at // 16
    return steps, nodes[0]


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda x: x[:3])
    tops = [climb([x[2] for x in by[s]], 0)[1] for s in order]
    out = []
    for k, s in enumerate(order):
        above, root = climb(tops, k)
        nodes = [x[2] for x in by[s]]
        for at, (_, _, own, r) in enumerate(by[s]):
            steps = climb(nodes, at)[0] + above
            hurt = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
            node = leaf(r, r[1].translate(LOWER)) if hurt else own
            for a, b in steps:
                node = digest(*a, node, *b)
            out.append((r[0], own, tops[k], root, digest(*(x for a, b in steps for x in (*a, *b))), node, node == root))
    return sorted(out, key=repr)


def run(spark, rows, depth=manifest.DEPTH):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as leaf", "1L as pos", "'g' as grp", "2 as digest").repartition(3)
    hurt = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return sorted((tuple(r) for r in manifest.manifest(df, hurt, lowered, depth).collect()), key=repr)


def table(n, sources):
    return [(k, f"Text {k}" if k % 11 else None, "en", sources[k % len(sources)] if k % 3 else sources[0], k % 50) for k in range(n)]


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_like_plain_trees(spark, depth):
    """Blocks of one level and two give several tiers; the result is the same."""
    rows = table(1100, [None, "a", "b", "ä", "", "z"])
    assert run(spark, rows, depth) == brute(rows)


def test_many_sources(spark):
    rows = [(k, "X", None, f"s{k % 300}", None) for k in range(600)]
    assert run(spark, rows, 1) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "A", "en", None, 1), (1, "", "en", "a", 0), (1, None, "en", "a", None), (2, "Same", "de", "a", 4), (2, "Same", "de", "a", 4), (3, "É WORD " * 30_000, "fr", "b", 9), (-5, "Minus", None, "", 5)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    one = run(spark, [(7, "lone", "en", "a", 4)])
    assert one == brute([(7, "lone", "en", "a", 4)]) and one[0][4] == hashlib.sha256(b"").hexdigest() and one[0][2] == one[0][3] == one[0][1]


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 700), st.booleans())
def test_traversal_like_whole_levels(n, more):
    """Paths of a block, with blocks beside it or without, against levels held whole."""
    nodes = [digest(str(k)) for k in range(n)]
    levels = [nodes]
    while len(levels[-1]) > 1 or more and len(levels) <= manifest.DEPTH:
        levels.append([digest(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    assert manifest.climbed(nodes, more) == levels[-1]
    for at, path in enumerate(manifest.paths(nodes, more)):
        want, k = [], at
        for level in levels[:-1]:
            lo = k // 16 * 16
            want.append((level[lo:k], level[k + 1 : lo + 16]))
            k //= 16
        assert path == want and manifest.folded(nodes[at], path) == levels[-1][0]


def test_traversal_holds_two_runs_a_level():
    seen = []

    class Watched(manifest.Level):
        def grow(self):
            super().grow()
            seen.append(len(self.existing) + len(self.desired))

    plain, manifest.Level = manifest.Level, Watched
    try:
        list(manifest.paths([digest(str(k)) for k in range(4096)], True))
    finally:
        manifest.Level = plain
    assert max(seen) <= 2 * manifest.FAN
