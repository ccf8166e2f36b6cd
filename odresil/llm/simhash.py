"""Near-duplicates by SimHash: 64-bit fingerprints compared bit plane by bit plane.

A bit of a fingerprint is 1 if it is set in over half the XXH64 values (seed 42) of the text's three-word shingles, repeats
included.  Fingerprints link where at most ``RADIUS`` bits differ.

Distinct fingerprints are classes.  Cut into four blocks of bits, two that differ in two bits agree in two whole blocks, so
each class goes to six buckets by the 32 bits of a pair of blocks.  Buckets of more than ``CROWD`` classes are cut again in
the same way over the bits that are still free: with 48 bits alike a bucket holds at most 65,536 classes, with 56 at most
256, so no group grows with the data and none is skipped.

A task takes its buckets sorted, as one vertical table: a plane for each free bit, a lane for each class, 64 lanes a word.
For each shift s all lanes are compared at once with the lanes s further on in their bucket: the planes' differences are
added to counters that are themselves bit planes (carry save), and words whose lanes all exceed the radius are abandoned.
Found links are joined in the task, which returns one link to the least lane of its set for each class; components of the
links follow by contraction.

Cases: null, empty and wordless texts have the fingerprint zero and link like any other; texts of one or two words are one
shingle; very long texts are read whole, their counts added up piece by piece; rows with the same doc_id are one document,
which each of their texts may link to others; a null doc_id links like any other and has the least id that it reaches, or
null; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base
from .minmax import components
from .textcols import normal_words

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Classes of a bucket above which it is cut again, lanes that are compared at a time, shingles whose bits are counted at a time.
CROWD, LANES, PIECE = 2048, 1 << 16, 1 << 16
FULL = (1 << 64) - 1


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles in turn, offsets of the texts in them)."""
    data, starts, stops, at = normal_words(texts)
    counts = np.diff(at)
    sizes = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    first = np.repeat(at[:-1] - bounds[:-1], sizes) + np.arange(bounds[-1])
    last = first + np.repeat(np.minimum(counts, SHINGLE), sizes) - 1
    whole, digest = data.tobytes(), xxhash.xxh64_intdigest
    found = [digest(whole[a:b], SEED) for a, b in zip(starts[first].tolist(), stops[last].tolist())]
    return np.array(found, np.uint64), bounds


def fingerprints(texts: pa.Array) -> np.ndarray:
    """The fingerprint of each text, as an unsigned number."""
    hashes, bounds = shingle_hashes(texts)
    n, sizes = len(bounds) - 1, np.diff(bounds)
    counts = np.zeros((n, 64), np.int64)
    owner = np.repeat(np.arange(n), sizes)
    for lo in range(0, len(hashes), PIECE):
        bits = np.unpackbits(hashes[lo : lo + PIECE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        mine = owner[lo : lo + PIECE]
        first = np.flatnonzero(np.diff(mine, prepend=-1))
        counts[mine[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    packed = np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8").ravel()


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, print): the fingerprint as a signed long."""
    base.small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1)).view(np.int64))], names=["doc_id", "print"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(base.lean(run), "doc_id long, print long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cuts(mask: int) -> list[int]:
    """The masks with two more of the four blocks into which the bits outside ``mask`` are cut."""
    free = [b for b in range(64) if not mask >> b & 1]
    size = len(free) // (RADIUS + 2)
    blocks = [sum(1 << b for b in free[k * size : (k + 1) * size]) for k in range(RADIUS + 2)]
    return [mask | sum(chosen) for chosen in combinations(blocks, 2)]


def _exceeds(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counters stand above the radius."""
    above, equal = over.copy(), ~np.zeros_like(over)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


def _united(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining the sets of each i and j: the least index of each set."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def close_sets(prints: np.ndarray, buckets: np.ndarray, mask: int, radius: int = RADIUS) -> np.ndarray:
    """For each lane the least lane of its set: lanes of a bucket link where at most ``radius`` bits outside ``mask`` differ.

    Lanes of a bucket stand together and agree in the bits of ``mask``."""
    n = len(prints)
    words = -(-n // 64)
    ends = np.searchsorted(buckets, buckets, "right")
    reach = np.zeros(words * 64, np.int64)
    reach[:n] = ends - np.arange(n) - 1
    reach = reach.reshape(words, 64)
    furthest, label = reach.max(1), np.arange(n)
    free = [b for b in range(64) if not mask >> b & 1]
    lanes = np.zeros((len(free), words * 64), np.uint8)
    for k, b in enumerate(free):
        lanes[k, :n] = prints >> np.uint64(b) & np.uint64(1)
    # planes that split the lanes most evenly come first, so that words can be abandoned early
    lanes = lanes[np.argsort(np.abs(lanes[:, :n].mean(1) - 0.5), kind="stable")]
    planes = np.zeros((len(free), 2 * words + 2), np.uint64)
    planes[:, :words] = np.packbits(lanes, axis=1, bitorder="little").view("<u8")
    size = max(radius.bit_length(), 1)
    for s in range(1, int(furthest.max(initial=0)) + 1):
        at = np.flatnonzero(furthest >= s)
        alive = np.packbits(reach[at] >= s, axis=1, bitorder="little").view("<u8").ravel()
        skip, r = at + s // 64, np.uint64(s % 64)
        counters, over = [np.zeros(len(at), np.uint64) for _ in range(size)], np.zeros(len(at), np.uint64)
        for k in range(len(free)):
            other = planes[k, skip] >> r
            if r:
                other |= planes[k, skip + 1] << (np.uint64(64) - r)
            carry = planes[k, at] ^ other
            for c in counters:
                c ^= carry
                carry &= ~c  # it was set and is not any more
            over |= carry
            if k % 4 == 3 or k == len(free) - 1:
                alive &= ~_exceeds(counters, over, radius)
                left = alive != 0
                if not left.any():
                    at = at[:0]
                    break
                if not left.all():
                    at, skip, alive, over, counters = at[left], skip[left], alive[left], over[left], [c[left] for c in counters]
        if len(at):
            word, bit = np.nonzero(np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            i = at[word] * 64 + bit
            label = _united(label, i, i + s)
    return label


def bucket_links(rows: DataFrame) -> DataFrame:
    """Links (a, b) that join the close classes of each bucket; rows are (mask, key, print)."""
    dealt = rows.repartition("mask", "key").sortWithinPartitions("mask", "key", "print")

    def compared(mask, key, prints):
        out = []
        for m in np.unique(mask):
            lo, hi = np.searchsorted(mask, m), np.searchsorted(mask, m, "right")
            bucket = np.cumsum(np.diff(key[lo:hi], prepend=key[lo]) != 0)
            label = close_sets(prints[lo:hi].view(np.uint64), bucket, int(m) & FULL)
            out.append(np.stack([prints[lo:hi], prints[lo:hi][label]])[:, label != np.arange(hi - lo)])
        a, b = np.concatenate(out, 1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches):
        held = np.zeros((3, 0), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([np.asarray(c) for c in batch.columns])], 1)
            if held.shape[1] >= LANES:  # the last bucket may go on
                cut = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0))
                if len(cut):
                    yield compared(*held[:, : cut[-1] + 1])
                    held = held[:, cut[-1] + 1 :]
        if held.shape[1]:
            yield compared(*held)

    return dealt.mapInArrow(base.lean(run), "a long, b long")


def close_links(classes: DataFrame) -> list[DataFrame]:
    """Tables of links (a, b) between classes (print) that differ in at most ``RADIUS`` bits; sets of links, not all pairs."""
    rows, masks, found = classes.select("print", F.lit(0).cast("long").alias("mask")), [0], []
    for level in range(3):
        children = F.create_map(*(x for m in masks for x in (F.lit(_signed(m)), F.array(*(F.lit(_signed(c)) for c in cuts(m))))))
        masks = sorted({c for m in masks for c in cuts(m)})
        # different cuts can lead to the same bits
        rows = rows.select("print", F.explode(children[F.col("mask")]).alias("mask"))
        rows = (rows.distinct() if level else rows).withColumn("key", F.col("print").bitwiseAND(F.col("mask")))
        sizes = base.written(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        fit = rows.join(sizes if level == 2 else sizes.where(F.col("n") <= CROWD), ["mask", "key"]).select("mask", "key", "print")
        found.append(base.written(bucket_links(fit), "links"))
        crowded = sizes.where(F.col("n") > CROWD)
        if level == 2 or not crowded.limit(1).count():
            return found
        rows = base.written(rows.join(crowded, ["mask", "key"]).select("print", "mask"), "crowded")
    return found


def link(docs: DataFrame) -> DataFrame:
    """(doc_id, print, component_id) of each row."""
    rows = base.written(fingerprinted(docs), "prints")
    classes = base.written(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "classes")
    links = close_links(classes)
    # rows of one doc_id with different texts are one document
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("print").alias("b"), F.max("print").alias("_top")).where("b <> _top")
    links.append(rows.join(several, "doc_id").where("print <> b").select(F.col("print").alias("a"), "b"))
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    labels = components(every.distinct())
    placed = base.written(classes.join(labels.withColumnRenamed("id", "print"), "print", "left").select("print", "least", F.coalesce("label", "print").alias("label")), "placed")
    least = base.written(placed.groupBy("label").agg(F.min("least").alias("component_id")), "least")
    named = base.written(placed.join(least, "label").select("print", "component_id"), "named")
    return rows.join(named, "print").select("doc_id", "print", "component_id")


def hexadecimal(fingerprint: Column) -> Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
