"""Vector codes: product quantisation of whole-number vectors by partial-distance search.

A vector's components become floor(256 x) and are cut into ``PARTS`` equal consecutive parts, each with a codebook of its
own.  A codebook starts as that part of the first ``ENTRIES`` kept vectors in the order of their ids; ``ROUNDS`` times every
part goes to its nearest entry and each entry becomes the floor of its parts' means; then parts are assigned for good.

The search takes a part's dimensions in descending variance of the codebook.  Each vector has a best complete distance from
the start, that of the entry nearest in the first of those dimensions; entries go by blocks, their squared differences are
added dimension by dimension, and those whose sum strictly exceeds the best complete distance are masked out of the arrays.
What is left of a block is complete and may lower the best.  Entries that tie are never masked, so the lowest index wins.

Vectors stay where they are: a pass maps batches to codes or to sums by entry, and only sums of tasks are shuffled.  The
driver holds the codebooks, ``ENTRIES`` times the width of a vector.

Cases: vectors that are null or hold null or non-finite components are dropped; rows with the same id are vectors each, in
the order of their components; a null id comes after all others; the width is that of the longest kept vector, rounded up
to a multiple of ``PARTS``, and shorter vectors (empty ones too) are filled up with zeros; with fewer kept vectors than
``ENTRIES`` codebooks have so many entries; null labels are one label; an empty table, or one without kept vectors, gives no
rows; columns other than vec_id, embedding and label are ignored; components so large that squared distances could leave
64 bits raise an error, for any code of them would be wrong.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries that are compared at a time, vectors of one array, labels whose sums are broadcast.
BLOCK, ROWS, FEW_LABELS = 16, 8192, 100_000
LARGEST = 1 << 30


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest row of ``book`` for each row of ``x``; ties go to the lower index."""
    if not len(x) or not x.shape[1]:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    order = np.argsort(-book.var(0), kind="stable")
    x, book, k = x[:, order], book[:, order], len(book)
    by_first = np.argsort(book[:, 0], kind="stable")
    right = np.minimum(np.searchsorted(book[by_first, 0], x[:, 0]), k - 1)
    left = np.maximum(right - 1, 0)
    closer = np.abs(book[by_first[left], 0] - x[:, 0]) <= np.abs(book[by_first[right], 0] - x[:, 0])
    guess = by_first[np.where(closer, left, right)]
    best = ((x - book[guess]) ** 2).sum(1) * k + guess  # distance and index in one number
    for lo in range(0, k, BLOCK):
        entries, most = book[lo : lo + BLOCK], best // k
        total = (x[:, :1] - entries[:, 0]) ** 2
        row, entry = np.nonzero(total <= most[:, None])
        total = total[row, entry]
        for d in range(1, x.shape[1]):
            total = total + (x[row, d] - entries[entry, d]) ** 2
            alive = total <= most[row]
            row, entry, total = row[alive], entry[alive], total[alive]
        if len(row):
            first = np.flatnonzero(np.diff(row, prepend=-1))
            best[row[first]] = np.minimum(best[row[first]], np.minimum.reduceat(total * k + entry + lo, first))
    return best % k, best // k


def largest(width: int) -> int:
    """The greatest magnitude of a component with which sums of squares and indexes stay within 64 bits."""
    return min(LARGEST, math.isqrt((1 << 62) // (ENTRIES * max(width // PARTS, 1))) // 2)


def scaled(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): the vectors without null and non-finite components as whole numbers."""
    base.small_batches(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    kind = rows.schema["label"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten()  # without what null rows may cover
            good = np.isfinite(np.asarray(flat.fill_null(math.nan), np.float64))
            sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
            bad = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[~good], minlength=len(sizes))
            kept = np.flatnonzero((bad == 0) & np.asarray(lists.is_valid()))
            values = np.floor(np.asarray(flat.fill_null(0.0), np.float64)[np.repeat(np.isin(np.arange(len(sizes)), kept), sizes)] * SCALE)
            if len(values) and np.abs(values).max() > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST // SCALE}: its squared distances do not fit 64 bits")
            offsets = np.concatenate([[0], np.cumsum(sizes[kept])]).astype(np.int32)
            whole = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))
            rest = batch.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([rest.column(0), rest.column(1), whole], names=["vec_id", "label", "v"])

    return rows.mapInArrow(base.lean(run), f"vec_id long, label {kind}, v array<int>")


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """The lists as rows of ``width`` numbers, filled up with zeros."""
    sizes = np.asarray(lists.value_lengths(), np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = np.asarray(lists.flatten(), np.int64)
    if len(out) and np.abs(out).max() > largest(width):
        raise ValueError(f"a component is beyond {largest(width) // SCALE}: its squared distances do not fit 64 bits")
    return out


def assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances) of vectors, a column a part."""
    size = x.shape[1] // PARTS
    found = [nearest(x[:, p * size : (p + 1) * size], books[p]) for p in range(PARTS)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def first_books(rows: DataFrame) -> np.ndarray:
    """Codebooks [part, entry, place] from the first vectors in the order of their ids."""
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-width // PARTS) * PARTS
    head = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    full = np.array([r.v + [0] * (width - len(r.v)) for r in head], np.int64).reshape(len(head), width)
    return full.reshape(len(head), PARTS, width // PARTS).transpose(1, 0, 2)


def refined(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry replaced by the floor of the means of the parts that are nearest to it; unused entries stay."""
    n, size = books.shape[1:]

    def run(batches):
        sums, counts = np.zeros((PARTS, n, size), np.int64), np.zeros((PARTS, n), np.int64)
        for batch in base.gathered(batches, 2, ROWS * PARTS * size * 4):
            x = matrix(batch.column(2), PARTS * size)
            codes, _ = assigned(x, books)
            for p in range(PARTS):
                np.add.at(sums[p], codes[:, p], x[:, p * size : (p + 1) * size])
                counts[p] += np.bincount(codes[:, p], minlength=n)
        part, entry = np.nonzero(counts)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * size, pa.int32()), pa.array(sums[part, entry].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), lists], names=["part", "entry", "n", "sums"])

    partial = rows.mapInArrow(base.lean(run), "part int, entry int, n long, sums array<long>")
    cells = partial.select("part", "entry", "n", F.posexplode("sums").alias("place", "total"))
    out = books.copy()
    for r in cells.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        out[r.part, r.entry, r.place] = r.total // r.n
    return out


def digest(books: np.ndarray) -> str:
    """sha256 of all entries' components, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): the parts' indexes in hex, two digits each, and the sum of their squared distances."""
    width, kind = books.shape[0] * books.shape[2], rows.schema["label"].dataType.simpleString()

    def run(batches):
        for batch in base.gathered(batches, 2, ROWS * max(width, 1) * 4):
            codes, far = assigned(matrix(batch.column(2), width), books)
            text = codes.astype(np.uint8).tobytes().hex()
            names = [text[2 * PARTS * k : 2 * PARTS * (k + 1)] for k in range(len(codes))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(far.sum(1))], names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(base.lean(run), f"vec_id long, label {kind}, code string, error long")


def fit(rows: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks of all rows after some rounds."""
    books = first_books(rows)
    for _ in range(rounds if books.size else 0):
        books = refined(rows, books)
    return books


def decoded(code: str, books: np.ndarray) -> list[int]:
    """The whole-number vector that a code stands for."""
    return [int(x) for p in range(PARTS) for x in books[p][int(code[2 * p : 2 * p + 2], 16)]]


def compress(vectors: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error, label_error) per kept vector, codebooks)."""
    rows = base.written(scaled(vectors), "vectors")
    books = fit(rows)
    codes = base.written(encoded(rows, books), "codes")
    base.remove_path(rows.sparkSession, rows.scratch)
    sums = base.written(codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "sums")
    few = sums.limit(FEW_LABELS + 1).count() <= FEW_LABELS  # beyond it both sides are shuffled, and a hot label's rows split
    out = codes.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("_label")))
    return out.drop("_label"), books
