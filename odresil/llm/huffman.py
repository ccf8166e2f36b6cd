"""Token-ID output: canonical length-limited Huffman coding in independently decodable blocks.

Format (two Parquet tables, so that any store Spark reaches can hold them):

* ``codebook``: one row ``lengths binary``, the code length of every id (one byte each, 0 for ids never seen).
  Codes are canonical: ascending by (length, id).
* ``blocks``: ``part, block, first`` (range partition, number of the block in it, tokens of the partition before the block),
  ``keys``/``sizes`` (ids and token counts of the documents, whole documents only), ``bits`` (big-endian bit stream)
  and ``marks`` (bit offset of every ``EVERY``-th token).  Partitions, blocks and documents ascend by doc_id.

Decoding looks up the next ``LIMIT`` bits in one table and runs over all marks of a block in step, so a block is
decoded in ``EVERY`` vector steps and any mark can be entered alone.

Cases: a null text is empty (the end id alone); rows with the same doc_id are kept each, ordered by a hash of their
text; null doc_ids come first; a very long text is one document of one block; an empty table gives a codebook without codes and no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base
from .bpe import encoder, id_counts, id_width, in_order, token_table

LIMIT, EVERY, BLOCK, END = 20, 128, 1 << 18, 1
BLOCKS = "part long, block long, first long, keys array<long>, sizes array<long>, bits binary, marks binary"


def limited_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for ``counts`` (0: no code), by package-merge."""
    seen = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(seen) <= 1:
        lengths[seen] = 1
        return lengths
    if len(seen) > 1 << limit:
        raise ValueError("more ids than codes of this length")
    order = seen[np.lexsort((seen, counts[seen]))]
    weight = counts[order].astype(np.float64) if counts.sum() > 1 << 62 else counts[order].astype(np.int64)
    levels, packages = [], np.empty(0, weight.dtype)
    for _ in range(limit):
        both = np.concatenate([weight, packages])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < len(order))  # which of the merged row are single ids
        merged = both[rank]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    take, depth = 2 * len(order) - 2, np.zeros(len(order), np.int64)
    for single in reversed(levels):
        n = int(single[:take].sum())
        depth[:n] += 1
        take = 2 * (take - n)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of every id, ascending by (length, id)."""
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        ids = np.flatnonzero(lengths == n)
        code <<= n - last
        last = n
        codes[ids] = code + np.arange(len(ids))
        code += len(ids)
    return codes


def encode_block(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, bytes]:
    """The bit stream of ``ids`` and its marks.

    Codes that start in the same 32 bits are put together in 64 bits, the later half of which goes to the next 32."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    marks = starts[::EVERY].astype("<u4").tobytes()
    if not len(ids):
        return b"", marks
    place = starts >> 5
    code = codes[ids].astype(np.uint64) << (64 - (starts & 31) - n).astype(np.uint64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    sums, at = np.add.reduceat(code, first), place[first]
    words = np.zeros(int(at[-1]) + 2, np.uint32)
    words[at] = (sums >> np.uint64(32)).astype(np.uint32)
    words[at + 1] |= (sums & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return words.astype(">u4").tobytes()[: int(ends[-1] + 7) // 8], marks


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every value of the next ``LIMIT`` bits, the id and the length of its code."""
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    spans = 1 << (LIMIT - lengths[ids].astype(np.int64))
    table = np.zeros(1 << LIMIT, np.uint32)
    filled = np.repeat(ids, spans)
    table[: len(filled)] = filled
    return table, lengths[table].astype(np.int64)


def decode_block(bits: bytes, marks: bytes, count: int, table, steps) -> np.ndarray:
    """The ``count`` ids of a block."""
    b = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint32)
    window = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
    at = np.frombuffer(marks, "<u4").astype(np.int64)
    out = np.zeros((EVERY, len(at)), np.uint32)
    last = len(window) - 1
    for k in range(EVERY):
        ahead = (window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> np.uint32(32 - LIMIT)
        out[k] = table[ahead]
        at = at + steps[ahead]
    return out.T.reshape(-1)[:count]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, partitions: int | None = None) -> None:
    """Tokenises the documents once, counts ids over all of them, and writes codebook and blocks under ``path``."""
    spark = docs.sparkSession
    tokens = token_table(docs, tokenizer, END)
    lengths = limited_lengths(id_counts(tokens))
    shared = spark.sparkContext.broadcast((lengths, canonical_codes(lengths)))  # as long as the vocabulary

    def run(batches):
        from pyspark import TaskContext

        lengths, codes = shared.value
        kind, part = id_width(encoder(tokenizer)), TaskContext.get().partitionId()
        keys, parts, size, first, serial = [], [], 0, 0, 0

        def flush():
            nonlocal keys, parts, size, first, serial
            ids = np.frombuffer(b"".join(parts), kind)
            bits, marks = encode_block(ids, lengths, codes)
            row = [part, serial, first, keys, [len(x) // kind.itemsize for x in parts], bits, marks]
            first, serial = first + size, serial + 1
            keys, parts, size = [], [], 0
            types = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2 + [pa.binary()] * 2
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=[x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys.append(key)
                parts.append(ids)
                size += len(ids) // kind.itemsize
                if size >= BLOCK:
                    yield flush()
        if keys:
            yield flush()

    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").write.parquet(f"{path}/codebook")
    ordered = in_order(tokens, partitions or max(1, docs.rdd.getNumPartitions()))
    ordered.mapInArrow(base.lean(run), BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    base.remove_path(spark, tokens.scratch)


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Decodes every block: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids."""
    lengths = np.frombuffer(spark.read.parquet(f"{path}/codebook").first()[0], np.uint8)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    totals = blocks.select("part", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before, sums = {}, 0  # a number for each range partition
    for part, n in sorted(map(tuple, totals.collect())):
        before[part], sums = sums, sums + n
    shared = spark.sparkContext.broadcast((lengths, before))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")

    def run(batches):
        lengths, before = shared.value
        table, steps = decode_table(lengths)
        for batch in batches:
            for part, _, first, keys, sizes, bits, marks in zip(*(c.to_pylist() for c in batch.columns)):
                flat = decode_block(bits, marks, sum(sizes), table, steps)
                ends = np.cumsum(sizes)
                raw = flat.astype("<u4").tobytes()
                crcs = [zlib.crc32(memoryview(raw)[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes)]
                cols = [pa.array(keys, pa.int64()), pa.array(before[part] + first + ends - np.array(sizes)), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in schema.split(", ")])

    base.small_batches(spark)
    return blocks.mapInArrow(base.lean(run), schema)
