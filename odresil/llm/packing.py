"""Packing: order-preserving dynamic programming over window cuts.

The token stream of consecutive documents is cut into sequences of at most ``length`` tokens.  A cut may lie at a
document's end (free), at a sentence's end (a small penalty) or, where a sentence is longer than ``stride`` tokens,
inside it (a larger one).  A sequence of n tokens costs its padding (``length - n``, nothing at a power of two)
plus the penalty of the cut that ends it.  With ``g(j) = best(j) + j`` the cheapest predecessor of a cut at ``i`` is
the minimum of ``g`` over the cuts of the last ``length`` tokens, which a monotone queue keeps; windows of a power
of two tokens are tried besides.

Documents are dealt in ascending doc_id to range partitions, and the programme runs over groups of about ``group``
tokens of a partition, so memory is bounded and a lost task gives the same sequences again.

Cases: a null text is empty and has the end id alone; a very long text is cut like any other and its group is as long
as it; of equally cheap predecessors the nearest is taken; rows with the same doc_id are packed each for itself, ordered by a hash of
their text; null doc_ids come first; an empty table gives no rows; other columns of the table are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import base
from .bpe import encoder, id_width, in_order, token_table

LENGTH, END = 2048, 1
#: Penalties in tokens of padding: a cut after a sentence, one inside a sentence, and each short window that needs no padding.
SENTENCE, INSIDE, SHORT = 6.0, 48.0, 96.0
STRIDE, GROUP = 64, 4_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def candidate_cuts(sizes: np.ndarray, stops: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the stream may be cut, ascending, and the penalty of each.

    sizes: tokens of each document; stops: for each token, whether a sentence ends with it."""
    total = int(sizes.sum())
    penalty = np.full(total + 1, np.inf)
    ends = np.cumsum(sizes)
    penalty[np.flatnonzero(stops) + 1] = SENTENCE
    penalty[ends] = 0.0
    marks = np.concatenate([[0], np.flatnonzero(np.isfinite(penalty[1:])) + 1])
    for lo, hi in zip(marks[:-1][np.diff(marks) > stride], marks[1:][np.diff(marks) > stride]):
        penalty[np.arange(lo + stride, hi, stride)] = INSIDE
    at = np.flatnonzero(np.isfinite(penalty[1:])) + 1
    return at, penalty[at]


def choose_cuts(at: np.ndarray, penalty: np.ndarray, length: int = LENGTH) -> list[int]:
    """The cuts of least total cost, the last of them the end of the stream.  Gaps between candidates must not pass ``length``."""
    places, costs = at.tolist(), penalty.tolist()
    best, before = {0: 0.0}, {}
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    powers = [1 << k for k in range(length.bit_length()) if 1 << k < length and 1 << k >= length // 4]
    for i, cost in zip(places, costs):
        low = i - length
        while queue[0][1] < low:
            queue.popleft()
        value, prior = queue[0][0] + length - i, queue[0][1]
        for p in powers:
            short = best.get(i - p)
            if short is not None and short + SHORT < value:
                value, prior = short + SHORT, i - p
        value += cost
        best[i], before[i] = value, prior
        g = value + i
        while queue and queue[-1][0] >= g:
            queue.pop()
        queue.append((g, i))
    cuts, i = [], places[-1] if places else 0
    while i:
        cuts.append(i)
        i = before[i]
    return cuts[::-1]


def sentence_ends(coder) -> np.ndarray:
    """For each id of the vocabulary, whether its text ends a sentence or line."""
    if not hasattr(coder, "stops"):
        shown = coder.tokenizer.decode_batch([[i] for i in range(coder.tokenizer.get_vocab_size())], skip_special_tokens=False)
        coder.stops = np.array([bool(re.search(r"[.!?…\n][^\w ]*$", x)) for x in shown])
    return coder.stops


def _pieces(sizes, stops):
    """For a group of documents: (document, start, length, sequence, offset) of each piece, as arrays."""
    at, penalty = candidate_cuts(sizes, stops)
    cuts = np.array(choose_cuts(at, penalty), np.int64)
    ends = np.cumsum(sizes)
    bounds = np.union1d(cuts, ends)
    starts = np.concatenate([[0], bounds[:-1]])
    doc, seq = np.searchsorted(ends, starts, "right"), np.searchsorted(cuts, starts, "right")
    return doc, starts, bounds - starts, seq, starts - np.concatenate([[0], cuts])[seq], ends - sizes


def pack(docs: DataFrame, tokenizer: str, ids: bool = True, partitions: int | None = None) -> DataFrame:
    """Packs every document; one row per piece, columns as in ``SCHEMA``, and with ``ids`` the piece's ids."""
    base.small_batches(docs.sparkSession)
    schema = SCHEMA + (", ids array<int>" if ids else "")

    def run(batches):
        from pyspark import TaskContext

        coder, part, serial = encoder(tokenizer), TaskContext.get().partitionId(), 0
        stop, kind = sentence_ends(coder), id_width(coder)
        keys, parts, held = [], [], 0

        def flush():
            nonlocal keys, parts, held, serial
            sizes, flat = np.array([len(x) for x in parts], np.int64), np.concatenate(parts)
            doc, starts, lengths, seq, offset, first = _pieces(sizes, stop[flat])
            crcs = [zlib.crc32(flat[a : a + n].astype("<u4").tobytes()) for a, n in zip(starts.tolist(), lengths.tolist())]
            cols = [pa.array([keys[d] for d in doc.tolist()], pa.int64()), starts - first[doc], lengths, crcs, sizes[doc], (part << 40) + serial + seq, offset]
            serial += int(seq[-1]) + 1
            cols = [c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in cols]
            if ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.append(starts, len(flat)).astype(np.int32)), pa.array(flat.astype(np.int32))))
            keys, parts, held = [], [], 0
            return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in schema.split(", ")])

        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys.append(key)
                parts.append(np.frombuffer(data, kind).astype(np.uint32))
                held += len(parts[-1])
                if held >= GROUP:
                    yield flush()
        if keys:
            yield flush()

    tokens = token_table(docs, tokenizer, END)
    return in_order(tokens, partitions or max(1, docs.rdd.getNumPartitions())).mapInArrow(base.lean(run), schema)
