"""Language identification by prediction by partial matching over bytes.

Every language gets a context tree of up to three bytes.  A context that has been seen gives a byte n times of t the
probability n / (t + d) and escapes to the next shorter context with d / (t + d), d being its distinct bytes; below
the empty context all 256 bytes are equally likely.  Statistics are frozen after training, so the code length of each
byte depends on its three predecessors alone.  The trees of all languages lie in one hashed table for each order, with an
entry for every (context, byte) that any language has seen: its exact code length in every language; and one for every
context: what its escape costs.  So memory follows what was seen, for any number of byte values and languages.  A text
goes to the language that codes it in the fewest bits; the score is that language's share of the posterior.

The share says nothing of texts in no learned language: it is near 1 for any text of some words.  ``judge`` therefore
goes by the code length itself, bits a byte under the best language.  Its limit is learned from rows the trees have not
seen: halfway from a language's own median to what texts cost under the best of the languages that are not theirs (8
bits where one language is learned); and the second language must cost more by ``NARROW`` of that distance.

Training and limits read every labelled row.  N-grams are counted on the executors and summed before they are collected: a
number for each (language, window of four bytes) seen, which grows with the variety of the texts, not with their number.

Cases: a null text or one without a letter gets ``und`` and score 0; very long texts are coded whole, in chunks; of
languages with equal code lengths the first by name is predicted; a null language is not learned; without any labelled
row, or on an empty table, every text gets ``und``; repeated rows are judged each for itself; other columns are kept
(those named like a result are replaced).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base

UNKNOWN = "und"
NARROW, RAW = 0.1, 8.0
PAD = b"\n\n\n"
CHUNK = 1 << 17
HELD = 1 << 21  # windows that a counting task holds for a language before it merges them, distinct ones before it hands them on


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over rows (lang, text): each byte with its three predecessors, packed into one number."""

    def run(batches):
        counted: dict[str, list] = {}  # pieces (windows, counts) of each language; the first is merged
        texts: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def merge(lang):
            b = np.frombuffer(PAD + PAD.join(texts.pop(lang)) + PAD, np.uint8).astype(np.uint32)  # pads around each, however they are dealt
            del size[lang]
            new = np.unique((b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:], return_counts=True)
            if lang in counted:
                grams, at = np.unique(np.concatenate([counted[lang][0], new[0]]), return_inverse=True)
                new = grams, np.bincount(at, np.concatenate([counted[lang][1], new[1]])).astype(np.int64)
            counted[lang] = new

        def out(lang):
            grams, n = counted.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = (text or "").encode()
                if not data:
                    continue
                texts.setdefault(lang, []).append(data)
                size[lang] = size.get(lang, 0) + len(data) + len(PAD)
                if size[lang] >= HELD:
                    merge(lang)
                    if len(counted[lang][0]) >= HELD:
                        yield out(lang)
        for lang in list(texts):
            merge(lang)
        for lang in list(counted):
            yield out(lang)

    return rows.mapInArrow(base.lean(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Places:
    """The places of ascending 32-bit keys, found by hashing: a key whose slot is taken goes to the next, smaller table."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.tables = keys.astype(np.uint32), []
        rest = np.arange(len(keys))
        while len(rest):
            bits = max(4, int(4 * len(rest) - 1).bit_length())
            table, times = np.full(1 << bits, -1, np.int32), np.uint32((2654435761 + 2 * 1013904223 * len(self.tables)) % (1 << 32) | 1)
            slots = self._slots(self.keys[rest], times, bits)
            first = np.unique(slots, return_index=True)[1]
            table[slots[first]] = rest[first]
            self.tables.append((times, bits, table))
            rest = np.delete(rest, first)

    @staticmethod
    def _slots(keys: np.ndarray, times: np.uint32, bits: int) -> np.ndarray:
        return (keys * times) >> np.uint32(32 - bits)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is none."""
        out, open_ = np.full(len(wanted), -1, np.int32), None
        for times, bits, table in self.tables:
            keys = wanted if open_ is None else wanted[open_]
            at = table[self._slots(keys, times, bits)]
            same = (self.keys[at] == keys) & (at >= 0)  # an empty slot: the key is in no table
            if open_ is None:
                out = np.where(same, at, -1)
                open_ = np.flatnonzero(~same & (at >= 0))
            else:
                out[open_[same]] = at[same]
                open_ = open_[~same & (at >= 0)]
            if not len(open_):
                break
        return out


class ByteTrees:
    """The frozen context trees of all languages as tables of code lengths in bits."""

    def __init__(self, grams: dict[str, tuple[np.ndarray, np.ndarray]]):
        """grams: for each language, the windows of four bytes as numbers, and how often each was seen."""
        self.langs = sorted(grams)
        keys = np.unique(np.concatenate([grams[lang][0] for lang in self.langs]))
        seen = np.zeros((len(keys), len(self.langs)))
        for k, lang in enumerate(self.langs):
            seen[np.searchsorted(keys, grams[lang][0]), k] = grams[lang][1]
        self.single, below = None, np.full((1, len(self.langs)), 1 / 256)
        self.entries: dict[int, tuple[Places, np.ndarray]] = {}
        self.escapes: dict[int, tuple[Places, np.ndarray]] = {}
        for order in (1, 2, 3, 4):  # bytes of the window: the context and the byte itself
            own, at = np.unique(keys & ((1 << 8 * order) - 1), return_inverse=True)
            counts = np.zeros((len(own), len(self.langs)))
            np.add.at(counts, at, seen)
            contexts, of = np.unique(own >> 8, return_inverse=True)
            total, kinds = np.zeros((2, len(contexts), len(self.langs)))
            np.add.at(total, of, counts)
            np.add.at(kinds, of, counts > 0)
            lower = below if order == 1 else below[np.searchsorted(shorter, own & ((1 << 8 * (order - 1)) - 1))]
            p = self._mixed(counts, total[of], kinds[of], lower)
            escape = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1)
            if order == 1:
                self.single = np.tile(self._mixed(np.zeros(1), total, kinds, 1 / 256), (256, 1))
                self.single[own] = p
                self.single = -np.log2(self.single).astype(np.float32)
            else:
                self.entries[order] = Places(own), -np.log2(p).astype(np.float32)
                self.escapes[order] = Places(contexts), -np.log2(escape).astype(np.float32)
            shorter, below = own, p

    @staticmethod
    def _mixed(counts, total, kinds, lower):
        return np.where(total > 0, (counts + kinds * lower) / np.maximum(total + kinds, 1), lower)

    def _costs(self, windows: np.ndarray, order: int = 4) -> np.ndarray:
        """Code lengths [window, language] of the last byte of each window of ``order`` bytes."""
        if order == 1:
            return self.single[windows]
        places, costs = self.entries[order]
        at = places.find(windows)
        out = costs[at] if len(costs) else np.zeros((len(windows), len(self.langs)), np.float32)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            some = windows[missing]
            contexts, escapes = self.escapes[order]
            where = contexts.find(some >> np.uint32(8))
            escape = np.where((where >= 0)[:, None], escapes[where], np.float32(0))
            out[missing] = escape + self._costs(some & np.uint32((1 << 8 * (order - 1)) - 1), order - 1)
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths [text, language]."""
        out = np.zeros((len(texts), len(self.langs)))
        held, size, first = [], 0, 0
        for k, t in enumerate(texts):
            held.append(t)
            size += len(t) + 3
            if size >= CHUNK or k == len(texts) - 1:
                self._add(held, out[first : k + 1])
                held, size, first = [], 0, k + 1
        return out

    def _add(self, texts: list[bytes], out: np.ndarray) -> None:
        s = np.frombuffer(PAD + PAD.join(texts) + PAD, np.uint8)
        ends = np.cumsum([len(t) + 3 for t in texts])
        starts = np.concatenate([[0], ends[:-1]]) + 3  # of the texts' own bytes
        for lo in range(3, len(s) - 3, CHUNK):
            hi = min(lo + CHUNK, len(s) - 3)
            part = s[lo - 3 : hi].astype(np.uint32)
            cost = self._costs((part[:-3] << 24) | (part[1:-2] << 16) | (part[2:-1] << 8) | part[3:])
            sums = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(cost, 0, dtype=np.float64)])
            b = np.clip(np.stack([starts, ends]), lo, hi) - lo
            out += sums[np.maximum(b[1], b[0])] - sums[b[0]]


def labelled(docs: DataFrame, learn: Column) -> DataFrame | None:
    """(lang, text) of all rows with both for which ``learn`` holds; None if there are none."""
    usable = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return usable if usable.limit(1).count() else None


def train(docs: DataFrame, learn: Column) -> ByteTrees | None:
    """Trees from the rows of ``docs`` (text, lang) for which ``learn`` holds."""
    base.small_batches(docs.sparkSession)
    rows = labelled(docs, learn)
    if rows is None:
        return None
    table = count_grams(rows).toArrow()
    coded = table["lang"].combine_chunks().dictionary_encode()
    of, names = np.asarray(coded.indices), coded.dictionary.to_pylist()
    grams, n = table["gram"].to_numpy(), table["n"].to_numpy()
    order = np.lexsort((grams, of))
    of, grams, n = of[order], grams[order], n[order]
    found = {lang: (grams[of == k], n[of == k]) for k, lang in enumerate(names)}
    return ByteTrees(found) if found else None


def _two_least(bits: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bits a byte under the best and the second language; without a second one a byte costs ``RAW``."""
    rates = np.sort(bits / np.array([len(t) for t in texts])[:, None], 1)
    return rates[:, 0], rates[:, 1] if rates.shape[1] > 1 else np.full(len(rates), RAW)


def identify(docs: DataFrame, model: ByteTrees | None) -> DataFrame:
    """``docs`` with lang_pred, score, bits_per_byte and margin (more bits a byte under the second language); columns of
    those names are replaced, and the last two are null for ``und``."""
    spark = docs.sparkSession
    base.small_batches(spark)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score", "bits_per_byte", "margin")])
    shared = spark.sparkContext.broadcast(model)  # an entry for each window seen
    position = [c.lower() for c in docs.columns].index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(position).to_pylist()
            named = np.array([model is not None and t is not None and any(map(str.isalpha, t)) for t in texts], bool)
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            rates, margins = np.full(len(texts), np.nan), np.full(len(texts), np.nan)
            at = np.flatnonzero(named)
            if len(at):
                data = [texts[k].encode() for k in at]
                bits = model.bits(data)
                rates[at], second = _two_least(bits, data)
                margins[at] = second - rates[at]
                best = bits.argmin(1)
                share = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                scores[at] = share
                for k, b in zip(at.tolist(), best.tolist()):
                    langs[k] = model.langs[b]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores), pa.array(rates, from_pandas=True), pa.array(margins, from_pandas=True)], names=[*batch.schema.names, "lang_pred", "score", "bits_per_byte", "margin"])

    return docs.mapInArrow(base.lean(run), f"{schema}, lang_pred string, score double, bits_per_byte double, margin double")


def limits(docs: DataFrame, model: ByteTrees) -> dict[str, tuple[float, float]]:
    """The most bits a byte and the least margin of each learned language, from the labelled rows, which ``model`` has not seen."""
    base.small_batches(docs.sparkSession)
    rows = labelled(docs, F.col("lang").isin(model.langs) & (F.length("text") > 0))
    if rows is None:
        return {}
    shared = docs.sparkSession.sparkContext.broadcast(model)  # an entry for each window seen

    def run(batches):
        model = shared.value
        place = {lang: k for k, lang in enumerate(model.langs)}
        for batch in batches:
            if not len(batch):
                continue
            data = [t.encode() for t in batch.column(1).to_pylist()]
            bits = model.bits(data)
            at = np.arange(len(data)), np.array([place[lang] for lang in batch.column(0).to_pylist()])
            own = bits[at] / np.array([len(t) for t in data])
            bits[at] = np.inf
            other = _two_least(bits, data)[0] if len(place) > 1 else np.full(len(data), RAW)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own), pa.array(other)], names=["lang", "own", "other"])

    bits = rows.mapInArrow(base.lean(run), "lang string, own double, other double")
    bits = base.written(bits, "bits")
    own, other = (base.quantiles(bits.select(F.col("lang").alias("key"), F.col(c).alias("value")), 0.5) for c in ("own", "other"))
    found = {lang: (own[lang], other[lang]) for lang in own}  # medians of a language
    shared.destroy()
    foreign = float(np.mean([other for _, other in found.values()]))
    usual = float(np.mean([own for own, _ in found.values()]))
    out = {}
    for lang in model.langs:
        own, other = found.get(lang, (usual, foreign))
        out[lang] = (own + max(foreign, other)) / 2, NARROW * (other - own)
    return out


def judge(docs: DataFrame, model: ByteTrees | None, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """``identify`` with ``accepted``: some language is known for the text and codes it within its ``limits``."""
    accepted = F.lit(False)
    for lang, (most, least) in bounds.items():
        accepted = F.when(F.col("lang_pred") == lang, (F.col("bits_per_byte") <= most) & (F.col("margin") >= least)).otherwise(accepted)
    return identify(docs, model).withColumn("accepted", accepted)
