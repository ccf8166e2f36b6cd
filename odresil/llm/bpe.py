"""Whole columns of text to token ids with the ``tokenizers`` library, one model call per distinct chunk.

A BPE pre-tokeniser never lets a piece reach across a single space between two other characters, nor from a letter or
digit over to closing punctuation, so a text is a sequence of chunks whose ids do not depend on their neighbours.  The
column's bytes are cut into chunks with array operations and Arrow numbers the distinct ones; only chunks that this
worker has not seen go through the library: plain words, numbers and punctuation straight to its model, all other
chunks through its whole normaliser and pre-tokeniser.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space beyond ASCII: texts with it are cut by a regular expression.
WIDE = "[\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
BETWEEN = re.compile(r"(?<=\S)(?= \S)")
LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+\Z")
MARKS = re.compile(r"[!-/:-@\[-`{-~]+\Z")
#: Chunks remembered by a worker, the longest chunk it remembers, and the bytes of text it takes at once.
REMEMBERED, LONGEST, AT_ONCE = 400_000, 48, 8_000_000
_BYTES = np.arange(256)
_SPACES = ((_BYTES >= 9) & (_BYTES <= 13)) | ((_BYTES >= 28) & (_BYTES <= 32))
_ALNUM = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122))
#: Second bytes of the letters from U+00C0 to U+00FF in UTF-8.
_LATIN_TAIL = (_BYTES >= 0x80) & (_BYTES <= 0xBF) & (_BYTES != 0x97) & (_BYTES != 0xB7)
_MARKS = (_BYTES > 32) & (_BYTES < 127) & ~_ALNUM


def _byte_table() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable ones stay, the others follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class ColumnEncoder:
    """Encodes string columns; ``spaced`` vocabularies mark a word's leading space, the others drop white space.

    The tokenizer stays as its file has it.  A text that holds the literal of an added token goes through the library
    as a whole, for such a literal is cut out before any other splitting.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.bytes = self.tokenizer.model, _byte_table()
        self.spaced = self.tokenizer.normalizer is None
        self.space = self.bytes[32] if self.spaced else ""
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.added = "|".join(re.escape(t.content) for t in added)
        self.all_whole = any(t.normalized for t in added)  # literals that are looked for after normalising
        #: Row in the pool of each remembered chunk, the space before it included.
        self.rows: dict[str, int] = {}
        self.sizes, self.ends, self.pool, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0

    def _model(self, piece: str) -> list[int]:
        """The ids of what the pre-tokeniser leaves in one piece."""
        return [t.id for t in self.model.tokenize(piece)]

    def _library(self, text: str) -> list[int]:
        """The ids of a text by the library's own splitting."""
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _chunk(self, chunk: str) -> list[int]:
        body, space = (chunk[1:], self.space) if chunk[:1] == " " else (chunk, "")
        if body.isascii():
            if body.isalpha():
                return self._model(space + (body if self.spaced else body.lower()))
            if body.isdigit():
                return self._model(space + body) if self.spaced else [i for d in body for i in self._model(d)]
            if MARKS.match(body) and (not space or not self.spaced):
                return self._model(body)
            if not body and not self.spaced:
                return []
        elif LATIN.match(body):
            mapped = (body if self.spaced else body.lower()).encode().decode("latin-1").translate(self.bytes)
            return self._model(space + mapped)
        return self._library(chunk)

    def _added_rows(self, found: list[list[int]]) -> np.ndarray:
        """New rows of the pool, one for each entry."""
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        first, at = self.count, int(self.ends[self.count - 1]) if self.count else 0
        self.count += len(found)
        if self.count > len(self.sizes):
            self.sizes, self.ends = (np.concatenate([x, np.zeros(self.count, np.int64)]) for x in (self.sizes, self.ends))
        total = at + int(sizes.sum())
        if total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(total, np.uint32)])
        self.sizes[first : self.count] = sizes
        self.ends[first : self.count] = at + np.cumsum(sizes)
        self.pool[at:total] = np.fromiter(chain.from_iterable(found), np.uint32, total - at)
        return np.arange(first, self.count)

    def _look_up(self, chunks: list[str]) -> np.ndarray:
        """The pool's row of each chunk."""
        rows = np.fromiter(map(self.rows.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(rows < 0).tolist()
        if missing:
            new = self._added_rows([self._chunk(chunks[k]) for k in missing])
            rows[missing] = new
            self.rows.update((chunks[k], r) for k, r in zip(missing, new.tolist()) if len(chunks[k]) <= LONGEST)
        return rows

    def _forget(self) -> None:
        """Drops the older half where much is remembered, so that memory stays bounded and common chunks come back soon."""
        while self.count > REMEMBERED or self.count > 1 and self.ends[self.count - 1] > 8 * REMEMBERED:
            half = self.count // 2
            at = int(self.ends[half - 1])
            self.rows = {k: r - half for k, r in self.rows.items() if r >= half}
            self.sizes, self.ends = self.sizes[half : self.count].copy(), self.ends[half : self.count] - at
            self.pool, self.count = self.pool[at:].copy(), self.count - half

    def _cuts(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where a chunk starts in the bytes of several texts that end at ``ends``: at a text, at a space, at closing marks."""
        if not len(data):
            return np.empty(0, np.int64)
        edge = np.zeros(len(data) + 1, bool)  # a text starts here
        edge[0] = True
        edge[ends] = True
        space = data == 32
        if self.spaced:  # only between two characters that are no white space
            white = _SPACES[data]
            space[1:] &= ~white[:-1]
            space[:-1] &= ~white[1:]
            space[edge[:-1] | edge[1:]] = False
        line = np.zeros(len(data) + 1, bool)  # a line feed that stands alone is a chunk
        if self.spaced:
            line[:-1] = data == 10
            line[1:-1] &= ~white[:-1]
            line[:-2] &= ~white[1:]
            line[edge] = False
            line[:-1] &= ~edge[1:]
        marks = _MARKS[data]
        letter = _ALNUM[data]
        letter[1:] |= (data[:-1] == 0xC3) & _LATIN_TAIL[data[1:]]
        tail = np.zeros(len(data), bool)
        tail[1:] = marks[1:] & letter[:-1]
        at = np.flatnonzero(tail & ~edge[:-1])
        if len(at):  # the marks must reach up to white space or the text's end
            stop = np.flatnonzero(~marks | edge[:-1])
            stop = np.append(stop, len(data))[np.searchsorted(stop, at, "right")]
            at = at[edge[stop] | _SPACES[np.append(data, 32)[stop]]]
        cut = space | edge[:-1] | line[:-1]
        cut[1:] |= line[:-2]
        cut[at] = True
        return np.flatnonzero(cut)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end as unsigned 32-bit integers, and the offsets of each text in them (one more than texts).

        Null counts as the empty text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        n, wide, whole = len(texts), np.zeros(len(texts), bool), np.zeros(len(texts), bool)
        if self.all_whole:
            whole[:] = True
        elif self.added:
            whole = np.asarray(pc.match_substring_regex(texts, self.added, ignore_case=True)).astype(bool)
        if self.spaced:
            wide = np.asarray(pc.match_substring_regex(texts, WIDE)).astype(bool) & ~whole
        odd, plain = np.flatnonzero(wide | whole), texts
        if len(odd):
            plain = pc.if_else(pa.array(wide | whole), "", texts)
        at = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + n + 1] if n else np.zeros(1, np.int64)
        data = np.frombuffer(plain.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        if not self.spaced:
            data = np.where(data == 10, np.uint8(32), data)
        cuts = self._cuts(data, at[1:])
        chunks = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(np.append(cuts, len(data))), pa.py_buffer(np.ascontiguousarray(data)))
        coded = chunks.dictionary_encode()
        rows = self._look_up(coded.dictionary.to_pylist())[np.asarray(coded.indices)] if len(cuts) else np.empty(0, np.int64)
        bounds = np.searchsorted(cuts, at)
        if len(odd):
            parts = np.split(rows, bounds[1:-1])
            for i in odd.tolist():
                text = texts[i].as_py()
                parts[i] = self._added_rows([self._library(text)]) if whole[i] else self._look_up(BETWEEN.split(text))
            rows, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        out = _gather(self.pool, self.ends - self.sizes, self.sizes, rows, bounds)
        self._forget()
        return out


def _gather(pool, starts, sizes, index, bounds):
    """The entries ``index`` of a ragged pool, end to end, and where each group of entries starts."""
    counts = sizes[index]
    ends = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(starts[index] - ends[:-1], counts) + np.arange(ends[-1])
    return pool[at], ends[bounds]


_encoders: dict[str, ColumnEncoder] = {}


def encoder(path: str) -> ColumnEncoder:
    """The worker's encoder for a vocabulary file; chunks stay known over the tasks of a worker."""
    if path not in _encoders:
        _encoders[path] = ColumnEncoder(path)
    return _encoders[path]


#: Rows of ``token_table``: a document's ids with the end id (``width`` bytes each, little-endian), or a task's counts.
TOKENS = "doc_id long, tie long, ids binary, counts binary"


def id_width(coder: ColumnEncoder) -> np.dtype:
    """Two bytes hold the ids of a vocabulary of at most 65,536 entries."""
    return np.dtype("<u2" if coder.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")


def token_table(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """Encodes every text where it lies and writes ``TOKENS``, so that only ids move later on.

    The last row of each task holds how often it met each id, instead of ids."""
    base.small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))

    def run(batches):
        coder, total = encoder(tokenizer), np.zeros(0, np.int64)
        kind = id_width(coder)
        for batch in base.gathered(batches, 1, AT_ONCE):
            flat, bounds = coder.encode(batch.column(1))
            flat = np.insert(flat, bounds[1:], end)
            found = np.bincount(flat, minlength=len(total))
            found[: len(total)] += total
            total = found
            at = (bounds + np.arange(len(bounds))) * kind.itemsize
            ids = pa.BinaryArray.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(flat.astype(kind))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), ids, pa.nulls(len(batch), pa.binary())], names=["doc_id", "tie", "ids", "counts"])
        last = [pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(last, names=["doc_id", "tie", "ids", "counts"])

    return base.written(rows.mapInArrow(base.lean(run), TOKENS), "tokens")


def in_order(tokens: DataFrame, partitions: int) -> DataFrame:
    """The documents of a token table as (doc_id, ids), in ascending order over range partitions.

    Rows of one doc_id follow each other by a hash of their text, within a partition and over their boundaries."""
    rows = tokens.where("ids is not null").select("doc_id", "tie", "ids")
    return rows.repartitionByRange(partitions, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "ids")


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs in a token table; as long as the vocabulary."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                found = np.zeros(max(len(total), len(x) // 8), np.int64)
                found[: len(total)] = total
                found[: len(x) // 8] += np.frombuffer(x, "<i8")
                total = found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    part = tokens.where("counts is not null").select("counts").mapInArrow(run, "id long, n long")
    rows = part.groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # a row for each id of the vocabulary at most
    counts = np.zeros(max(rows["id"].to_pylist(), default=0) + 1, np.int64)
    counts[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return counts
