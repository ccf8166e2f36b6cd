"""Arrow columns of text to numbered ASCII-white-space words, without a Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_white = _lower.copy()
_white[9:14] = 32


def _cut(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with blanks as spaces, starts and stops of the words in them, offsets of the texts among the words)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    data = _white[data] if lower else np.where((data >= 9) & (data <= 13), np.uint8(32), data)
    ends = at - at[0]
    blank = data == 32
    first = ~blank
    first[1:] &= blank[:-1]
    cut = ends[:-1][(ends[:-1] < len(data))]
    first[cut] |= ~blank[cut]
    last = ~blank
    last[:-1] &= blank[1:]
    shut = ends[1:][ends[1:] > 0] - 1
    last[shut] |= ~blank[shut]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return data, starts, stops, np.searchsorted(starts, ends)


def normal_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, stops, offsets of the texts among the words): lower-cased words with one space between those of a text."""
    data, starts, stops, at = _cut(texts, True)
    kept = data != 32
    kept[stops[stops < len(data)]] = True  # the first byte behind a word: a blank, or the next text
    place = np.cumsum(kept) - 1
    return np.ascontiguousarray(data[kept]), place[starts], place[stops - 1] + 1, at


def word_column(texts: pa.Array, lower: bool = True) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words as bytes, number of each word in turn, offsets of the texts in them); words are runs of
    characters other than U+0020 and U+0009-U+000D, A-Z lower-cased if asked for.  Null counts as empty."""
    data, starts, stops, at = _cut(texts, lower)
    # words end to end without the blanks between them
    bounds = np.concatenate([[0], np.cumsum(stops - starts)])
    flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[data != 32]))])
    coded = flat.dictionary_encode()
    return coded.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int64), at


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of every word."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (multiply and xor-shift, twice)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
