"""Language-model scores from a sharded Elias-Fano n-gram trie.

The model is an interpolated, absolutely discounted n-gram model over words and an end token; below the pairs stands
the add-one word distribution.  It learns from every training row, so its size follows the input.

Texts become blocks of about ``BLOCK`` bytes: numbered words, written once.  A block's distinct n-grams with their
training counts go to shards by their first word; there are as many shards as keep about ``SHARD`` tokens each.  A shard
merges the counts of all blocks, builds a trie with one level for each order, and answers each block's questions;
nothing of the model passes through the driver but the number of tokens and of distinct words.  A block sends a shard
one packed message and none where it has no n-gram for it, so there are never more messages than n-grams.

The root level holds the first words; a node of a further level is a successor of a node of the level above, whose
pointers give its range.  Words, pointers and successors are monotone sequences in Elias-Fano code (a successor is
stored with its parent's rank in front, so the sequence rises).  A node's smoothed probability has its context's total
as denominator, kept once for each context, and a discounted count as numerator, kept in two bytes on one fixed grid:
exact up to ``EXACT``, then ``STEPS`` steps to each doubling (an error below 0.04 percent).  Levels lie in a
memory-mapped file that has no name, so nothing stays behind when a task is lost.  A query goes down from the first word
and searches in each level the range its parent's pointers give.

A context with more than its share of all n-grams would fill a shard by itself, so its successors are dealt over
several.  Each holds the nodes on the way to it without their counts and answers with its own total; a block adds the
totals up.  Counts are whole numbers and the grid is fixed, so the numbers of blocks, shards and parts change the work's
spread only, never a score.

Words are told apart by 64 bits of their hash, successors of one context by ``WORD_BITS`` bits: among a million
different successors of one context less than one pair is expected to be taken for the same word.

Cases: null and empty texts have the end token alone; a very long text is one block; without training rows every token
has probability 1 / 1; an empty table gives no rows; repeated rows count and are scored each; null doc_ids are scored
too; a null ``learn`` counts as false; columns other than the named ones are ignored.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base
from .textcols import mixed, word_column, word_hashes

ORDER, DISCOUNT = 3, 0.75
#: Bytes of text of a block; tokens of a shard; words that messages name by two bytes; contexts that are split at most.
BLOCK, SHARD, COMMON, SPLIT = 6_000_000, 1_000_000, 65_535, 1_000_000
#: Counts of a block below which a word or context is no candidate for the last two.
LEAST_SEEN = 8
WORD_BITS, EXACT, STEPS = 40, 4096, 1024
END, START = np.uint64(0xE2D0000000000001), np.uint64(0x57A0000000000003)
ODD = np.uint64(0xC2B2AE3D27D4EB4F)
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


# ---------------------------------------------------------------- Elias-Fano


class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit numbers: low bytes as they are, high parts in unary."""

    def __init__(self, count: int, low_bytes: int, low: np.ndarray, high: np.ndarray):
        self.count, self.low_bytes, self.low, self.high = count, low_bytes, low, high
        self._starts = None

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        width = 0
        if n and int(values[-1]) > n:
            width = min(8, (max(int(values[-1]) // n, 1).bit_length() - 1) // 8)
            while width < 8 and int(values[-1]) >> (8 * width) > 16 * n + 64:
                width += 1
        low = values.view(np.uint8).reshape(n, 8)[:, :width]
        upper = (values >> np.uint64(8 * width)).astype(np.int64) if width < 8 else np.zeros(n, np.int64)
        bits = np.zeros(n + (int(upper[-1]) if n else 0) + 1, np.uint8)
        bits[upper + np.arange(n)] = 1
        return cls(n, width, np.ascontiguousarray(low).reshape(-1), np.packbits(bits))

    def _lows(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        rows = self.low.reshape(self.count, self.low_bytes) if self.low_bytes else None
        for k in range(self.low_bytes):
            out |= rows[at, k].astype(np.uint64) << np.uint64(8 * k)
        return out

    def _bounds(self) -> np.ndarray:
        """How many values lie below each high part."""
        if self._starts is None:
            bits = np.unpackbits(self.high)
            zero = np.flatnonzero(bits == 0)
            self._starts = np.minimum(np.concatenate([[0], zero - np.arange(len(zero))]), self.count)
        return self._starts

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high))[: self.count]
        upper = (ones - np.arange(self.count)).astype(np.uint64)
        return self._lows(np.arange(self.count)) | (upper << np.uint64(8 * self.low_bytes) if self.low_bytes < 8 else np.uint64(0))

    def find(self, wanted: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """The place of each wanted value within [lo, hi), found as its successor; -1 where the successor is another value."""
        starts = self._bounds()
        upper = np.minimum(wanted >> np.uint64(8 * self.low_bytes), np.uint64(1 << 62)).astype(np.int64) if self.low_bytes < 8 else np.zeros(len(wanted), np.int64)
        last = len(starts) - 1
        a, b = starts[np.minimum(upper, last)], starts[np.minimum(upper + 1, last)]
        if self.low_bytes == 8:
            b = np.full(len(wanted), self.count)
        if lo is not None:
            a, b = np.clip(a, lo, hi), np.clip(b, lo, hi)
        rest = wanted & np.uint64((1 << (8 * self.low_bytes)) - 1)
        a, end = a.copy(), b.copy()
        b = b.copy()
        while len(open_ := np.flatnonzero(a < b)):
            mid = (a[open_] + b[open_]) >> 1
            less = self._lows(mid) < rest[open_]
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]
        out = np.full(len(wanted), -1, np.int64)
        inside = np.flatnonzero(a < end)
        same = inside[self._lows(a[inside]) == rest[inside]]
        out[same] = a[same]
        return out


# ---------------------------------------------------------------- trie


def to_grid(counts: np.ndarray) -> np.ndarray:
    """The grid's number of each count; 0 for none."""
    high = EXACT + np.rint(STEPS * np.log2(np.maximum(counts, EXACT) / EXACT))
    return np.where(counts <= EXACT, counts, np.minimum(high, 65_535)).astype(np.uint16)


def from_grid(codes: np.ndarray) -> np.ndarray:
    """The discounted count that a number of the grid stands for."""
    codes = codes.astype(np.float64)
    counts = np.where(codes <= EXACT, codes, EXACT * np.exp2((codes - EXACT) / STEPS))
    return np.where(codes > 0, counts - DISCOUNT, 0.0)


class TrieLevel:
    """The successors of the level above's nodes: pointers, words and quantised probabilities in a memory-mapped file."""

    def __init__(self, parents: int, nodes: np.ndarray, counts: np.ndarray):
        """parents: nodes of the level above; nodes: parent's rank and word, ascending; counts: 0 for nodes that only lead on."""
        parent = (nodes >> np.uint64(WORD_BITS)).astype(np.int64)
        self.total = np.bincount(parent, counts, parents).astype(np.int64)
        self.kinds = np.bincount(parent, counts > 0, parents).astype(np.int64)
        starts = np.searchsorted(parent, np.arange(parents + 1))
        parts = [EliasFano.encode(starts), EliasFano.encode(nodes)]
        with tempfile.TemporaryFile() as f:
            places = []
            for data in [x for p in parts for x in (p.low, p.high)] + [to_grid(counts)]:
                f.write(b"\0" * (-f.tell() % 8))
                places.append((f.tell(), len(data)))
                f.write(memoryview(np.ascontiguousarray(data)))
            f.write(b"\0")
            f.flush()
            self.file = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        views = [np.frombuffer(self.file, np.uint8, n, at) for at, n in places[:4]]
        self.pointers, self.nodes = (EliasFano(p.count, p.low_bytes, views[2 * k], views[2 * k + 1]) for k, p in enumerate(parts))
        self.codes = np.frombuffer(self.file, np.uint16, places[4][1], places[4][0])
        self.starts = None

    def query(self, parents: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The ranks of the parents' successors, searched in each parent's own range; -1: not found, or no parent."""
        if not self.nodes.count:
            return np.full(len(words), -1, np.int64)
        if self.starts is None:
            self.starts = self.pointers.values().astype(np.int64)
        at = np.maximum(parents, 0)
        wanted = (at.astype(np.uint64) << np.uint64(WORD_BITS)) | words.astype(np.uint64)
        return np.where(parents >= 0, self.nodes.find(wanted, self.starts[at], self.starts[at + 1]), -1)

    def answer(self, places: np.ndarray) -> np.ndarray:
        """The grid's numbers at places; 0: not found."""
        if not self.nodes.count:
            return np.zeros(len(places), np.uint16)
        return np.where(places >= 0, self.codes[np.maximum(places, 0)], 0).astype(np.uint16)

    def context(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Totals and kinds of successors of nodes of the level above; 0 for -1."""
        some = places >= 0
        at = np.where(some, places, 0)
        if not len(self.total):
            return np.zeros(len(places), np.uint64), np.zeros(len(places), np.uint32)
        return np.where(some, self.total[at], 0).astype(np.uint64), np.where(some, self.kinds[at], 0).astype(np.uint32)


# ---------------------------------------------------------------- blocks


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes in one zstd frame; what ascends is handed over as differences."""
    head, planes = [], []
    for x in arrays:
        x = np.ascontiguousarray(x)
        head.append(np.array([len(x)], "<u8").tobytes() + x.dtype.str.encode().ljust(4))
        if len(x):
            planes.append(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())
    data = zstandard.ZstdCompressor(level=1).compress(b"".join(planes))
    return np.array([len(head)], "<u8").tobytes() + b"".join(head) + data


def _unpack(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, "<u8", 1)[0])
    heads = [(int(np.frombuffer(data, "<u8", 1, 8 + 12 * k)[0]), np.dtype(data[16 + 12 * k : 20 + 12 * k].decode().strip())) for k in range(n)]
    size = sum(count * kind.itemsize for count, kind in heads)
    planes = zstandard.ZstdDecompressor().decompress(data[8 + 12 * n :], max_output_size=size) if size else b""
    out, at = [], 0
    for count, kind in heads:
        part = np.frombuffer(planes, np.uint8, count * kind.itemsize, at).reshape(kind.itemsize, count)
        out.append(np.ascontiguousarray(part.T).reshape(-1).view(kind))
        at += count * kind.itemsize
    return out


def _rises(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


class Block:
    """The tokens of some texts, numbered by the order of their hashes, and their n-grams."""

    def __init__(self, keys: np.ndarray, token: np.ndarray, sizes: np.ndarray):
        """keys: hashes of the distinct words, ascending, with the end token; token: places in them; sizes: tokens of each text."""
        self.keys, self.token, self.sizes = keys, token, sizes
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.first = np.cumsum(sizes) - sizes

    @classmethod
    def of(cls, texts: pa.Array) -> Block:
        words, index, at = word_column(texts)
        n_words = np.diff(at)
        keys, back = np.unique(np.append(mixed(word_hashes(words)), END), return_inverse=True)
        ends = np.cumsum(n_words + 1)
        token = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        last = np.zeros(len(token), bool)
        last[ends - 1] = True
        token[last], token[~last] = back[-1], back[index]
        return cls(keys, token, n_words + 1)

    def levels(self, order: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """The root words, and of each order from 2 on (parent, word, pair): the place in the level above and among the root
        words of each distinct n-gram, ascending, and the n-gram of each token.

        An n-gram of start tokens alone is added where those of the next order begin with it."""
        roots = np.unique(np.append(self.keys, START))
        token, begin = np.searchsorted(roots, self.keys).astype(np.int32)[self.token], int(np.searchsorted(roots, START))
        start, node, out = begin, token, []
        for _ in range(order - 1):
            above = np.empty(len(token), np.int64)
            above[1:] = node[:-1]
            above[self.first] = begin
            above *= len(roots)
            above += token
            codes, pair = np.unique(np.append(above, begin * len(roots) + start), return_inverse=True)
            begin, node = int(pair[-1]), pair[:-1].astype(np.int32)
            del pair
            out.append(((codes // len(roots)).astype(np.int32), (codes % len(roots)).astype(np.int32), node))
        return roots, out


class Dealing:
    """Which n-grams of a block go to which shard: its own and those on the way to them, all shards at once.

    An n-gram's own shard is that of its first word, but for successors of split contexts.  So most n-grams find all that
    leads to them among their shard's own, and only the others need further entries."""

    def __init__(self, block: Block, order: int, shards: int, parts: dict[int, int]):
        self.roots, self.levels = block.levels(order)
        self.words = self.roots >> np.uint64(64 - WORD_BITS)
        hashes = mixed(self.roots)
        homes = [(hashes % np.uint64(shards)).astype(np.int32)]
        more: list[list[np.ndarray]] = [[] for _ in range(order)]  # entries at shards that are not the row's own
        hot = np.array(sorted(parts), np.uint64)
        times = np.array([parts[int(h)] for h in hot], np.int64)
        for k, (parent, word, _) in enumerate(self.levels):
            home, n = homes[k][parent], len(homes[k])
            if len(hot):
                at = np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)
                split = np.where(hot[at] == hashes, np.minimum(times[at], shards), 1)
                for row in np.flatnonzero(split > 1).tolist():  # every part tells its total
                    more[k].append((int(homes[k][row]) + np.arange(1, split[row])) % shards * n + row)
                some = np.flatnonzero(split[parent] > 1)
                share = (self.words[word[some]] % split[parent[some]].astype(np.uint64)).astype(np.int64)
                home[some] = ((home[some] + share) % shards).astype(np.int32)
                hashes = mixed(hashes[parent] * ODD + self.roots[word])
            homes.append(home)
        #: Of each level: row of every entry, by shard; where a shard's entries start; whether a shard is the row's own;
        #: the place of an entry's parent among its shard's entries.
        self.rows: list[np.ndarray] = [np.empty(0, np.int64)] * order
        self.starts, self.own, self.above = list(self.rows), list(self.rows), list(self.rows)
        codes, place = list(self.rows), list(self.rows)
        for k in range(order - 1, -1, -1):
            n = len(homes[k])
            row = np.argsort(homes[k].astype(np.uint16) if shards <= 1 << 16 else homes[k], kind="stable")
            codes[k], self.own[k] = homes[k][row].astype(np.int64) * n + row, np.ones(n, bool)
            if more[k]:
                codes[k] = np.concatenate([codes[k], np.unique(np.concatenate(more[k]))])
                order_ = np.argsort(codes[k], kind="stable")
                codes[k], self.own[k] = codes[k][order_], order_ < n
                row = codes[k] % n
            self.rows[k], self.starts[k] = row.astype(np.int32), np.searchsorted(codes[k], np.arange(shards + 1) * n)
            place[k] = np.empty(n, np.int32)
            place[k][row[self.own[k]]] = np.flatnonzero(self.own[k])
            if k:
                shard = (codes[k] // n).astype(np.int32)
                self.above[k] = self.levels[k - 1][0][row]
                astray = np.flatnonzero(homes[k - 1][self.above[k]] != shard)
                if len(astray):
                    more[k - 1].append(shard[astray].astype(np.int64) * len(homes[k - 1]) + self.above[k][astray])
        for k in range(1, order):
            parent, shard = self.above[k], (codes[k] // len(homes[k])).astype(np.int32)
            at = place[k - 1][parent]
            astray = np.flatnonzero(homes[k - 1][parent] != shard)
            at[astray] = np.searchsorted(codes[k - 1], shard[astray].astype(np.int64) * len(homes[k - 1]) + parent[astray])
            self.above[k] = at - self.starts[k - 1].astype(np.int32)[shard]

    def shards(self) -> list[int]:
        """The shards that get something: each entry has its root there."""
        return np.flatnonzero(np.diff(self.starts[0])).tolist()


def frequent(words: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each word, 1 + its place in ``common``, or 0."""
    if not len(common):
        return np.zeros(len(words), np.uint16)
    order = np.argsort(common)
    at = np.minimum(np.searchsorted(common, words, sorter=order), len(common) - 1)
    return np.where(common[order[at]] == words, order[at] + 1, 0).astype(np.uint16)


def questions(block: Block, train: np.ndarray, order: int, shards: int, parts: dict[int, int], common: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """For each shard, the packed words and n-grams of a block with their counts in training rows."""
    dealt, learn = Dealing(block, order, shards, parts), train[block.doc]
    short = frequent(dealt.words, common)
    count = np.zeros(len(dealt.roots), np.int64)
    count[np.searchsorted(dealt.roots, block.keys)] = np.bincount(block.token[learn], minlength=len(block.keys))
    rows = dealt.rows[0]
    root, counts = dealt.roots[rows], [np.where(dealt.own[0], count[rows], 0).astype(np.uint32)]
    words = [None]
    for k, (parent, word, pair) in enumerate(dealt.levels, 1):
        rows = dealt.rows[k]
        words.append(word[rows])
        counts.append(np.where(dealt.own[k], np.bincount(pair[learn], minlength=len(parent))[rows], 0).astype(np.uint32))
    for s in dealt.shards():
        at = slice(dealt.starts[0][s], dealt.starts[0][s + 1])
        arrays = [_rises(root[at]), counts[0][at]]
        for k in range(1, order):
            at = slice(dealt.starts[k][s], dealt.starts[k][s + 1])
            code = short[words[k][at]]
            arrays += [_rises(dealt.above[k][at].astype(np.uint32)), code, dealt.words[words[k][at][code == 0]], counts[k][at]]
        yield s, _pack(*arrays)


def answers(asked: list[tuple[int, bytes]], order: int, common: np.ndarray) -> tuple[dict[int, list[np.ndarray]], int, int]:
    """A shard: merges the blocks' counts, builds its trie level by level and answers every block."""
    got = [(block, _unpack(data)) for block, data in asked]
    first = [np.cumsum(x[0], dtype=np.uint64) for _, x in got]
    roots, at = np.unique(np.concatenate(first), return_inverse=True)
    if len(roots) >> (64 - WORD_BITS):
        raise ValueError("too many words in one shard: SHARD must be smaller")
    count = np.rint(np.bincount(at, np.concatenate([x[1] for _, x in got]))).astype(np.int64)
    tokens, kinds = int(count.sum()), int((count > 0).sum())
    root, above = EliasFano.encode(roots), len(roots)
    ranks = [root.find(f) for f in first]
    out = {block: [count[r].astype(np.uint64)] for (block, _), r in zip(got, ranks)}
    # n-grams of training rows and those on the way to one are the trie's nodes
    parents, kept = [], []
    for _, x in got:
        parents.append([np.cumsum(x[2 + 4 * k], dtype=np.int64) for k in range(order - 1)])
        keep = [x[5 + 4 * k] > 0 for k in range(order - 1)]
        for k in range(order - 2, 0, -1):
            keep[k - 1][parents[-1][k][keep[k]]] = True
        kept.append(keep)
    for k in range(order - 1):
        over = [r[p[k]] for r, p in zip(ranks, parents)]
        words = []
        for _, x in got:
            code, word = x[3 + 4 * k], np.empty(len(x[3 + 4 * k]), np.uint64)
            word[code == 0] = x[4 + 4 * k]
            word[code > 0] = common[code[code > 0].astype(np.int64) - 1]
            words.append(word)
        nodes = [(o[keep[k]].astype(np.uint64) << np.uint64(WORD_BITS)) | w[keep[k]] for o, w, keep in zip(over, words, kept)]
        nodes, at = np.unique(np.concatenate(nodes), return_inverse=True)
        n = np.bincount(at, np.concatenate([x[5 + 4 * k][keep[k]] for keep, (_, x) in zip(kept, got)]), len(nodes))
        level = TrieLevel(above, nodes, np.rint(n).astype(np.int64))
        above = len(nodes)
        if above >> (64 - WORD_BITS):
            raise ValueError("too many n-grams in one shard: SHARD must be smaller")
        del nodes, n
        done = 0
        for i, (block, _) in enumerate(got):
            places = np.empty(len(over[i]), np.int64)
            n, mine = int(kept[i][k].sum()), kept[i][k]
            places[mine] = at[done : done + n]  # nodes know their rank from the merge; the others are looked for
            places[~mine] = level.query(over[i][~mine], words[i][~mine])
            done += n
            out[block] += [*level.context(ranks[i]), level.answer(places)]
            ranks[i] = places
    return out, tokens, kinds


def scores(block: Block, found: list[tuple[int, list[np.ndarray]]], order: int, shards: int, parts: dict[int, int], tokens: int, kinds: int):
    """n_tokens, n_known, base score and score of each text of a block, from the answers of all its shards."""
    dealt = Dealing(block, order, shards, parts)
    found = [x for _, x in sorted(found, key=lambda r: r[0])]  # as the entries are ordered
    joined = [np.concatenate([x[k] for x in found]) if found else np.zeros(0) for k in range(1 + 3 * (order - 1))]
    count = np.zeros(len(dealt.roots), np.int64)
    count[dealt.rows[0][dealt.own[0]]] = joined[0][dealt.own[0]]
    count = count[np.searchsorted(dealt.roots, block.keys)]
    p = (count + 1) / (tokens + kinds + 1)
    n_docs = len(block.sizes)
    known = np.bincount(block.doc, (count > 0)[block.token], n_docs).astype(np.int64)
    plain = np.bincount(block.doc, np.log10(p)[block.token], n_docs)
    p, above = p[block.token], len(dealt.roots)
    for k, (parent, _, pair) in enumerate(dealt.levels, 1):
        rows, own = dealt.rows[k], dealt.own[k]
        share = np.zeros(len(parent))
        share[rows[own]] = from_grid(joined[3 * k][own])
        context = dealt.rows[k - 1]
        total, sorts = (np.bincount(context, joined[3 * k - 2 + j], above) for j in (0, 1))
        seen, total = total > 0, np.maximum(total, 1)
        rest = np.where(seen, DISCOUNT * sorts / total, 1)
        p = (share / total[parent])[pair] + rest[parent][pair] * p
        above = len(parent)
    return block.sizes, known, plain, np.bincount(block.doc, np.log10(p), n_docs)


# ---------------------------------------------------------------- Spark


def blocks_of(docs: DataFrame, learn: Column, size: int) -> DataFrame:
    """(block, tokens, data): the texts where they lie, as numbered words in packed blocks; written to the shared folder."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(learn, F.lit(False)).alias("train"))

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        for batch in base.gathered(batches, 1, size):
            b = Block.of(batch.column(1))
            ids = batch.column(0)
            columns = [ids.fill_null(0).to_numpy(), np.asarray(ids.is_valid()), np.asarray(batch.column(2)).astype(bool)]
            data = _pack(_rises(b.keys), b.token.astype(np.uint32), b.sizes.astype(np.uint32), *columns)
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([len(b.token)]), pa.array([data], pa.binary())], names=["block", "tokens", "data"])
            part += 1

    return base.written(rows.mapInArrow(base.lean(run), "block long, tokens long, data binary"), "blocks")


def _opened(data: bytes) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray]:
    """A block with the ids of its texts, whether they are not null, and whether they train."""
    keys, token, sizes, ids, named, train = _unpack(data)
    return Block(np.cumsum(keys, dtype=np.uint64), token.astype(np.int32), sizes.astype(np.int64)), ids, named, train


def survey(blocks: DataFrame, order: int, shards: int, tokens: int) -> tuple[dict[int, int], np.ndarray]:
    """Contexts with more than a quarter of a shard's share of all tokens and in how many parts each is dealt, and the most
    frequent words.

    What is that frequent overall is as frequent in some block.  Both are bounded (``SPLIT``, ``COMMON``) and shape
    messages and the work's spread only."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                block = _opened(data)[0]
                roots, levels = block.levels(order - 1)
                n, hashes = np.bincount(np.searchsorted(roots, block.keys)[block.token], minlength=len(roots)), mixed(roots)
                some = n >= LEAST_SEEN
                names, counts, word = [(roots >> np.uint64(64 - WORD_BITS))[some]], [n[some]], [np.ones(int(some.sum()), bool)]
                least = max(LEAST_SEEN, len(block.token) // (4 * shards))
                for k in range(order - 1):
                    some = n >= least
                    names.append(hashes[some])
                    counts.append(n[some])
                    word.append(np.zeros(int(some.sum()), bool))
                    if k < len(levels):
                        parent, last, pair = levels[k]
                        n, hashes = np.bincount(pair, minlength=len(parent)), mixed(hashes[parent] * ODD + roots[last])
                arrays = [np.concatenate(names).astype(np.int64), np.concatenate(counts).astype(np.int64), np.concatenate(word)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, arrays)), names=["name", "n", "word"])

    seen = blocks.select("data").mapInArrow(base.lean(run), "name long, n long, word boolean").groupBy("word", "name").agg(F.sum("n").alias("n"))
    seen = base.written(seen, "survey")
    common = seen.where("word").orderBy(F.desc("n"), "name").limit(COMMON).collect()
    heavy = seen.where(~F.col("word") & (F.col("n") * 4 * shards >= tokens)).orderBy(F.desc("n"), "name").limit(SPLIT).collect() if shards > 1 else []
    base.remove_path(blocks.sparkSession, seen.scratch)
    parts = {r.name % (1 << 64): min(shards, -(-r.n * 4 * shards // max(tokens, 1))) for r in heavy}
    return {h: n for h, n in parts.items() if n > 1}, np.array([r.name % (1 << 64) for r in common], np.uint64)


def score(docs: DataFrame, learn: Column, order: int = ORDER, shards: int | None = None, block: int = BLOCK) -> DataFrame:
    """One row for each document, columns as in ``SCHEMA``; rows for which ``learn`` holds train the model."""
    spark = docs.sparkSession
    base.small_batches(spark)
    blocks = blocks_of(docs, learn, block)
    size = blocks.agg(F.sum("tokens")).first()[0] or 0
    n = shards or max(1, -(-size // SHARD))
    shared = spark.sparkContext.broadcast(survey(blocks, order, n, size))  # bounded by SPLIT and COMMON

    def ask(batches):
        parts, common = shared.value
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                b, _, _, train = _opened(data)
                out = list(questions(b, train, order, n, parts, common))
                columns = [pa.array([s for s, _ in out], pa.int64()), pa.array([name] * len(out), pa.int64()), pa.array([d for _, d in out], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "block", "data"])

    def answer(table: pa.Table) -> pa.Table:
        asked = list(zip(table["block"].to_pylist(), table["data"].to_pylist()))
        out, tokens, kinds = answers(asked, order, shared.value[1])
        names, k = list(out), len(out)
        columns = {"block": names, "shard": [table["shard"][0].as_py()] * k, "data": [_pack(*out.pop(b)) for b in names], "tokens": [tokens] * k, "kinds": [kinds] * k}
        return pa.table({c: pa.array(v, pa.binary() if c == "data" else pa.int64()) for c, v in columns.items()})

    asked = blocks.select("block", "data").mapInArrow(base.lean(ask), "shard long, block long, data binary")
    answered = asked.groupBy("shard").applyInArrow(base.lean_group(answer), "block long, shard long, data binary, tokens long, kinds long")
    answered = base.written(answered, "answers")
    sums = answered.groupBy("shard").agg(F.max("tokens").alias("t"), F.max("kinds").alias("k")).agg(F.sum("t"), F.sum("k")).first()
    tokens, kinds = sums[0] or 0, sums[1] or 0

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        b, ids, named, train = _opened(left["data"][0].as_py())
        found = [(s, _unpack(d)) for s, d in zip(right["shard"].to_pylist(), right["data"].to_pylist())]
        sizes, known, plain, own = scores(b, found, order, n, shared.value[0], tokens, kinds)
        columns = [pa.array(ids, mask=~named), ~train, sizes.astype(np.int64), known, np.full(len(sizes), tokens), plain, own]
        return pa.table([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return blocks.select("block", "data").groupBy("block").cogroup(answered.select("block", "shard", "data").groupBy("block")).applyInArrow(base.lean_pair(finish), SCHEMA)
