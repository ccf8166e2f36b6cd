"""Benchmark decontamination: prefix-filtered set join with exact verification over item-sized windows.

A window is ``size`` consecutive item words, or the whole item where it has fewer.  Its shingles (up to three words)
are ordered by rarity, counted over all documents; for exact containment the prefix that must be joined is the one
rarest shingle.  An inverted index maps that shingle to (window, position).  A document joins its shingles with the
index, drops candidates whose window would start before or end after the text (length and positional bounds), and
verifies the others word by word.

The index of a benchmark is broadcast in blocks of at most ``block`` words; a larger benchmark takes one pass over the
documents for each block, so what is broadcast never grows with the data.

Cases: null or wordless texts have no words and are not contaminated; very long texts are searched whole, very long items
in parts; equally rare shingles: the first of the window; items without words have no windows; an item
with a null id marks words but is neither listed nor counted; repeated item ids count once; repeated document rows
are judged each for itself; an empty benchmark leaves every document clean; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

WINDOW, SHINGLE, BLOCK_WORDS = 13, 3, 2_000_000  # three word numbers of a block fit into 63 bits
#: In UTF-8 every byte of a character beyond ASCII is 0x80 or more, so words can be found in the bytes.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Words as the contract has them, after lower-casing A-Z, as UTF-8."""
    return WORD.findall(text.encode().lower()) if text else []


class WindowIndex:
    """Windows of some items, by their rarest shingle."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], size: int = WINDOW, shingle: int = SHINGLE):
        self.number: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set] = {}
        for name, words in items:
            ids = [self.number.setdefault(w, len(self.number)) for w in words]
            for k in range(max(1, len(ids) - size + 1) if ids else 0):
                windows.setdefault(tuple(ids[k : k + size]), set()).add(name)
        self.size, self.shingle, self.base = size, shingle, len(self.number) + 1
        self.windows = [np.array(w, np.int64) for w in windows]
        self.names = list(windows.values())
        # shingles of n words, for every n that some window needs: windows shorter than a shingle are one themselves
        self.vocabulary = {n: np.unique(np.concatenate([self.grams(w, n) for w in self.windows if min(len(w), shingle) == n])) for n in {min(len(w), shingle) for w in self.windows}}
        self.counts = {n: np.zeros(len(v), np.int64) for n, v in self.vocabulary.items()}

    def grams(self, ids: np.ndarray, n: int) -> np.ndarray:
        """The n-word shingles as numbers; -1 where a word is unknown."""
        if len(ids) < n:
            return np.empty(0, np.int64)
        code, known = np.zeros(len(ids) - n + 1, np.int64), np.ones(len(ids) - n + 1, bool)
        for k in range(n):
            part = ids[k : len(ids) - n + 1 + k]
            code, known = code * self.base + part, known & (part >= 0)
        return np.where(known, code, -1)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.number.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def count(self, ids: np.ndarray, into: dict[int, np.ndarray]) -> None:
        """Adds the shingles of one document."""
        for n, v in self.vocabulary.items():
            code = self.grams(ids, n)
            code = code[code >= 0]
            at = np.searchsorted(v, code)
            at = at[v[np.minimum(at, len(v) - 1)] == code]
            into[n] += np.bincount(at, minlength=len(v))

    def order(self, counts: dict[int, np.ndarray]) -> None:
        """Chooses each window's prefix: its rarest shingle under ``counts``, the first of equally rare ones."""
        self.prefix: dict[int, tuple] = {}
        chosen: dict[int, list] = {n: [] for n in self.vocabulary}
        for k, w in enumerate(self.windows):
            n = min(len(w), self.shingle)
            code = self.grams(w, n)
            at = int(np.argmin(counts[n][np.searchsorted(self.vocabulary[n], code)]))
            chosen[n].append((int(code[at]), at, k))
        for n, rows in chosen.items():
            keys, pos, win = np.array(sorted(rows), np.int64).T
            self.prefix[n] = (keys, pos, win)

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, set]:
        """Which words lie inside an occurrence of a window, and the items of the windows found."""
        hit, names, n_words = np.zeros(len(ids) + 1, np.int64), set(), len(ids)
        for n, (keys, pos, win) in self.prefix.items():
            code = self.grams(ids, n)
            lo, hi = np.searchsorted(keys, code, "left"), np.searchsorted(keys, code, "right")
            hi[code < 0] = lo[code < 0]
            for q in np.flatnonzero(hi > lo).tolist():
                for c in range(int(lo[q]), int(hi[q])):
                    w = self.windows[win[c]]
                    start = q - int(pos[c])
                    if start < 0 or start + len(w) > n_words:
                        continue
                    if np.array_equal(ids[start : start + len(w)], w):
                        hit[start] += 1
                        hit[start + len(w)] -= 1
                        names |= self.names[win[c]]
        return np.cumsum(hit)[:-1] > 0, names


def _blocks(benchmark: DataFrame, size: int, block: int):
    """Indexes of bounded numbers of item words, one at a time: items are read part by part."""
    items, held = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).orderBy("i", "t").toLocalIterator():
        words = words_of(row.t)
        # a long item comes in parts that share the words of all windows but one at their borders
        for at in range(0, max(1, len(words) - size + 1), block):
            part = words[at : at + block + size - 1]
            if held and held + len(part) > block:
                yield WindowIndex(items, size)
                items, held = [], 0
            items.append((row.i, part))
            held += len(part)
    if held:
        yield WindowIndex(items, size)


def _rarity(docs: DataFrame, shared) -> dict[int, np.ndarray]:
    """How often each shingle of the index occurs in all documents; as long as the index."""

    def run(batches):
        index = shared.value
        total = {n: np.zeros(len(v), np.int64) for n, v in index.vocabulary.items()}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                index.count(index.numbers(words_of(text)), total)
        for n, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n)), pa.array(at), pa.array(c[at])], names=["n", "at", "c"])

    out = {n: c.copy() for n, c in shared.value.counts.items()}
    for n, at, c in docs.select(F.col("text").cast("string")).mapInArrow(run, "n long, at long, c long").groupBy("n", "at").agg(F.sum("c")).collect():
        out[n][at] = c
    return out


def find_overlap(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block: int = BLOCK_WORDS) -> DataFrame:
    """The documents' columns with ``n_words``, ``hits`` (word spans [from, to) inside windows, merged) and ``items``."""
    spark = docs.sparkSession
    base.small_batches(spark)
    taken = {"n_words", "hits", "items"} & {c.lower() for c in docs.columns}
    out = docs.drop(*[c for c in docs.columns if c.lower() in taken])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    position = [c.lower() for c in out.columns].index("text")
    extra = "n_words long, hits array<struct<from:long,to:long>>, items array<string>"
    pairs = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
    first = True
    for index in _blocks(benchmark, size, block):
        counted = spark.sparkContext.broadcast(index)
        index.order(_rarity(docs, counted))
        counted.destroy()
        shared, again = spark.sparkContext.broadcast(index), not first

        def run(batches, shared=shared, again=again):
            index = shared.value
            for batch in batches:
                texts = batch.column(position).to_pylist()
                old = batch.columns[-2:] if again else None
                n_words, hits, items = [], [], []
                for k, text in enumerate(texts):
                    words = words_of(text)
                    mask, names = index.search(index.numbers(words))
                    if old:
                        for span in old[0][k].as_py():
                            mask[span["from"] : span["to"]] = True
                        names |= set(old[1][k].as_py())
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                    n_words.append(len(words))
                    hits.append([{"from": a, "to": b} for a, b in edge.reshape(-1, 2).tolist()])
                    items.append(sorted(x for x in names if x is not None))
                cols = [*batch.columns[: -3 if again else None], pa.array(n_words, pa.int64()), pa.array(hits, pairs), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[: -3 if again else None], "n_words", "hits", "items"])

        out = (base.written(out, "overlap") if again else out).mapInArrow(run, f"{schema}, {extra}")
        first = False
    if first:

        def none(batches):
            for batch in batches:
                n = [len(words_of(t)) for t in batch.column(position).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array([[]] * len(n), pairs), pa.array([[]] * len(n), pa.list_(pa.string()))], names=[*batch.schema.names, "n_words", "hits", "items"])

        out = out.mapInArrow(none, f"{schema}, {extra}")
    return out


def judged(docs: DataFrame, benchmark: DataFrame, share: int = 20) -> DataFrame:
    """``find_overlap`` with n_hit, n_items, items_sha256 and contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["to"] - x["from"])
    out = find_overlap(docs, benchmark).withColumn("n_hit", hit)
    return out.withColumns(
        {
            "n_items": F.size("items").cast("long"),
            "items_sha256": F.sha2(F.array_join("items", ","), 256),
            "contaminated": (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")),
        }
    )

