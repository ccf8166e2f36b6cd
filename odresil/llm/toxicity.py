"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: how dense words of a lexicon are, their strongest weight and their number, how near they
stand to a second-person pronoun, shares of capitals, punctuation and exclamation marks, and how many words hide
letters behind digits or symbols.  The lexicon is learned from the labelled rows: words and word beginnings that
occur almost only in toxic ones.  Lexicon features of a training row come from a lexicon learned without its fold,
and the calibration from predictions made without it.

Fitting uses at most ``MOST`` labelled rows, chosen by hash (a documented bound); their terms are counted and their
features made on the executors, so the driver gets the lexicon and ``MOST`` rows of numbers.  Scoring is a map over all
rows and whole texts.

Cases: null and empty texts score as texts without words; very long texts are read whole, one at a time; rows of several
labels of one doc_id are toxic if any is; null labels and null doc_ids are not learned, and exact repeats of a row are
learned once; equal splits of a tree: the first feature and least bin; without any label, or with one class only, every
score is the share of toxic labels; an empty table gives no rows; repeated rows are scored each for itself; other
columns are kept (those named score or predicted are replaced).
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base

MOST, FOLDS, PARTS = 6000, 4, 24
LEAST, RATIO = 3, 12.0
WORD = re.compile(r"[^\W_]+(?:['’*@$!0-9._-]*[^\W_]+)*")
PREFIXES = (4, 5, 6, 7, 8)
#: Second-person pronouns of the common languages (fixed values).
SECOND = frozenset("you your yours yourself yourselves u ur ya thou du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo tuya usted ustedes vosotros vos os".split())
#: Digits and symbols that stand for letters (fixed values).
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, ".": None, "_": None, "-": None, "'": None, "’": None})
NAMES = ("density", "strongest", "hits", "near_second", "second_density", "capitals", "capital_words", "punctuation", "exclamations", "disguised", "repeats", "word_length", "log_words", "weight_sum")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def plain_word(word: str) -> str:
    """The word without disguise."""
    return word if word.isalpha() else word.translate(DISGUISE)


def terms_of(words: list[str]) -> set[str]:
    """What the lexicon may hold of a text: whole words, and beginnings marked by a star."""
    out = set()
    for w in set(map(plain_word, words)):
        out.add(w)
        out.update(w[:k] + "*" for k in PREFIXES if len(w) >= k)
    return out


def weight(bad: float, good: float, n1: float, n0: float) -> float:
    """How much likelier, in ln, a toxic text holds a term than another text does."""
    return float(np.log((bad + 0.5) / (max(n1, 1) + 1)) - np.log((good + 0.5) / (max(n0, 1) + 1)))


class Features:
    """The feature row of a text under a lexicon; words are rated once."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.rated = lexicon, {}

    def rate(self, word: str) -> float:
        if len(self.rated) > 500_000:
            self.rated.clear()
        p, lexicon = plain_word(word), self.lexicon
        v = self.rated[word] = max([lexicon.get(p, 0.0), *(lexicon.get(p[:k] + "*", 0.0) for k in PREFIXES if len(p) >= k)])
        return v

    def row(self, text: str | None, words: list[str] | None = None) -> list[float]:
        text = text or ""
        words = words_of(text) if words is None else words
        rated, n = self.rated, max(len(words), 1)
        rates = [rated[w] if w in rated else self.rate(w) for w in words]
        at = [k for k, v in enumerate(rates) if v]
        second = [k for k, w in enumerate(words) if w in SECOND]
        near = 0.0
        if at and second:
            near = 1.0 / (1.0 + min(_gaps(at, second)))
        chars = max(len(text), 1)
        caps = sum(map(str.isupper, text))
        marks = sum(text.count(c) for c in ".,;:!?\"()")
        odd = sum(not w.isalpha() for w in words)
        best = max(rates, default=0.0)
        return [len(at) / n, best, float(min(len(at), 50)), near, len(second) / n, caps / chars, float(caps / chars > 0.3), marks / chars, text.count("!") / chars, odd / n, 1 - len(set(words)) / n, sum(map(len, words)) / n, float(np.log1p(len(words))), float(sum(rates)) / n]


def _gaps(at: list[int], second: list[int]) -> list[int]:
    """For each position, the distance to the nearest second-person word."""
    a, s = np.array(at), np.array(second)
    k = np.searchsorted(s, a)
    return np.minimum(np.abs(a - s[np.minimum(k, len(s) - 1)]), np.abs(a - s[np.maximum(k - 1, 0)])).tolist()


class BoostedTrees:
    """Depth-limited regression trees on the gradient of the logistic loss, split on quantile bins."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._binned(x)
        p0 = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.start = float(np.log(p0 / (1 - p0)))
        f, self.grown = np.full(len(y), self.start), []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            tree, step = self._grow(b, p - y, p * (1 - p))
            self.grown.append(tree)
            f += step
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], 1)

    def _grow(self, b, g, h):
        """A tree as (feature, bin) of each inner node in heap order, and the leaves' steps."""
        inner, node = [(-1, 0)] * (2**self.depth - 1), np.zeros(len(g), np.int64)
        for k in range(2**self.depth - 1):
            rows = np.flatnonzero(node == k)
            best, choice = 1e-6, (-1, 0)
            if len(rows):
                total_g, total_h = g[rows].sum(), h[rows].sum()
                for j, edges in enumerate(self.edges):
                    m = len(edges) + 1
                    left_g, left_h = np.cumsum(np.bincount(b[rows, j], g[rows], m))[:-1], np.cumsum(np.bincount(b[rows, j], h[rows], m))[:-1]
                    right_h = total_h - left_h
                    gain = left_g**2 / (left_h + self.least) + (total_g - left_g) ** 2 / (right_h + self.least) - total_g**2 / (total_h + self.least)
                    if len(gain) and gain.max() > best:
                        best, choice = float(gain.max()), (j, int(gain.argmax()))
            inner[k] = choice
            j, cut = choice
            node[rows] = 2 * k + 1 + ((b[rows, j] > cut).astype(np.int64) if j >= 0 else 0)
        leaf = node - (2**self.depth - 1)
        g_sum, h_sum = np.bincount(leaf, g, 2**self.depth), np.bincount(leaf, h, 2**self.depth)
        steps = -self.rate * g_sum / (h_sum + self.least)
        return (inner, steps), steps[leaf]

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, f = self._binned(x), np.full(len(x), self.start)
        for inner, steps in self.grown:
            node, split = np.zeros(len(x), np.int64), np.array(inner)
            for _ in range(self.depth):
                j, cut = split[node, 0], split[node, 1]
                node = 2 * node + 1 + ((b[np.arange(len(x)), np.maximum(j, 0)] > cut) & (j >= 0))
            f += steps[node - (2**self.depth - 1)]
        return f


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: ascending knots and the calibrated value of each."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order]):
        blocks.append([float(s), float(s), float(v), 1.0])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            lo, hi = blocks[-2], blocks.pop()
            lo[1], lo[2], lo[3] = hi[1], lo[2] + hi[2], lo[3] + hi[3]
    # one row of each class is added to the ends, so that no score is quite 0 or 1
    x = np.array([v for b in blocks for v in (b[0], b[1])])
    p = np.array([v for b in blocks for v in [(b[2] + 0.01) / (b[3] + 0.02)] * 2])
    return x, np.maximum.accumulate(p)


class ToxicityModel:
    """Lexicon, trees and calibration, fitted on feature rows ``x`` that come from lexicons without their own fold."""

    def __init__(self, x: np.ndarray, toxic: np.ndarray, fold: np.ndarray, lexicon: dict[str, float]):
        y = np.asarray(toxic, float)
        self.constant = float(y.mean()) if len(y) else 0.0
        self.fitted = usable(y)
        if not self.fitted:
            return
        margin = np.zeros(len(y))
        for k in np.unique(fold):
            if 0 < y[fold != k].sum() < (fold != k).sum():
                margin[fold == k] = BoostedTrees().fit(x[fold != k], y[fold != k]).margin(x[fold == k])
        self.knots, self.values = isotonic(margin, y)
        self.trees = BoostedTrees().fit(x, y)
        self.lexicon = lexicon

    def score(self, texts: list[str | None], features: Features) -> np.ndarray:
        if not self.fitted or not texts:
            return np.full(len(texts), self.constant)
        x = np.array([features.row(t) for t in texts])
        return np.clip(np.interp(self.trees.margin(x), self.knots, self.values), 0, 1)


def usable(toxic: np.ndarray) -> bool:
    """Whether there are rows of both classes, and enough of them."""
    return len(toxic) >= 20 and 0 < toxic.sum() < len(toxic)


def labelled(docs: DataFrame, labels: DataFrame, learn: Column, most: int) -> DataFrame:
    """(doc_id, tie, fold, toxic, text): at most ``most`` rows with a label, those of least hash; written to the shared folder.

    Keys are chosen first, so that the texts stay on the executors.  Rows of one doc_id fall into one fold."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learn)
    marks = marks.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("_id"), "_id").limit(most)
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("tie"))
    keys = rows.select("doc_id", "tie").join(F.broadcast(marks), F.col("doc_id") == F.col("_id"))  # at most ``most`` ids
    keys = keys.select("_id", F.col("tie").alias("_tie"), "toxic").distinct().orderBy(F.xxhash64("_id"), "_id", "_tie").limit(most)
    found = rows.join(F.broadcast(keys), (rows.doc_id == F.col("_id")) & (rows.tie == F.col("_tie")))  # at most ``most`` rows
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    found = found.select("doc_id", "tie", fold.alias("fold"), "toxic", "text").dropDuplicates(["doc_id", "tie"])
    return base.written(found.repartition(PARTS, "doc_id", "tie"), "labelled")


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, b0.., g0..): how many toxic and other texts of each fold hold a term; texts stay on the executors."""

    def run(batches):
        counts: dict[tuple[int, int], Counter] = {}
        for batch in batches:
            for fold, toxic, text in zip(*(c.to_pylist() for c in batch.columns)):
                counts.setdefault((fold, toxic > 0), Counter()).update(terms_of(words_of(text)))
        for (fold, toxic), found in counts.items():
            n = len(found)
            columns = [list(found), [fold] * n, [toxic] * n, list(found.values())]
            types = [pa.string(), pa.int32(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["term", "fold", "bad", "n"])

    found = rows.select("fold", "toxic", "text").mapInArrow(base.lean(run), "term string, fold int, bad boolean, n long")
    some = lambda k, bad: F.sum(F.when((F.col("fold") == k) & (F.col("bad") == bad), F.col("n")).otherwise(0))
    return found.groupBy("term").agg(
        *(some(k, True).alias(f"b{k}") for k in range(FOLDS)), *(some(k, False).alias(f"g{k}") for k in range(FOLDS))
    )


def learn_lexicons(rows: DataFrame, n1: list[int], n0: list[int], least: int = LEAST, ratio: float = RATIO) -> list[dict[str, float]]:
    """A lexicon without each fold, and one of all rows: terms that at least ``least`` toxic texts hold and that are
    ``ratio`` times likelier in toxic ones, with ln of that.  Only terms of some lexicon reach the driver."""
    counts, passed = term_counts(rows), F.lit(False)
    parts = [[j for j in range(FOLDS) if j != k] for k in range(FOLDS)] + [list(range(FOLDS))]
    for part in parts:
        bad, good = sum(F.col(f"b{j}") for j in part), sum(F.col(f"g{j}") for j in part)
        share = (bad + 0.5) / (max(sum(n1[j] for j in part), 1) + 1) * (max(sum(n0[j] for j in part), 1) + 1) / (good + 0.5)
        passed = passed | ((bad >= least) & (share >= ratio * 0.999))
    lexicons: list[dict[str, float]] = [{} for _ in parts]
    for term, *n in sorted(map(tuple, counts.where(passed).collect())):
        for part, lexicon in zip(parts, lexicons):
            bad, good = sum(n[j] for j in part), sum(n[FOLDS + j] for j in part)
            if bad >= least and (w := weight(bad, good, sum(n1[j] for j in part), sum(n0[j] for j in part))) >= np.log(ratio):
                lexicon[term] = w
    return lexicons


def feature_rows(rows: DataFrame, lexicons: list[dict[str, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and folds of the labelled rows, in a fixed order; only these numbers reach the driver."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicons)

    def run(batches):
        makers = [Features(x) for x in shared.value]
        for batch in batches:
            texts, folds = batch.column(4).to_pylist(), batch.column(2).to_pylist()
            x = pa.array([makers[k].row(t) for k, t in zip(folds, texts)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], x], names=["doc_id", "tie", "fold", "toxic", "x"])

    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, tie long, fold int, toxic int, x array<double>"
    found = rows.mapInArrow(run, schema).toArrow().sort_by([("doc_id", "ascending"), ("tie", "ascending")])
    x = np.array(found["x"].combine_chunks().values if len(found) else []).reshape(-1, len(NAMES))
    return x, (found["toxic"].to_numpy() > 0).astype(float), found["fold"].to_numpy()


def train(docs: DataFrame, labels: DataFrame, learn: Column, most: int = MOST) -> ToxicityModel:
    """Fits on at most ``most`` rows with a label for which ``learn`` (over doc_id) holds."""
    base.small_batches(docs.sparkSession)
    rows = labelled(docs, labels, learn, most)
    n1, n0 = [0] * FOLDS, [0] * FOLDS
    for fold, bad, n in rows.groupBy("fold").agg(F.sum(F.expr("int(toxic > 0)")), F.count("*")).collect():
        n1[fold], n0[fold] = bad, n - bad
    lexicons = learn_lexicons(rows, n1, n0)
    model = ToxicityModel(*feature_rows(rows, lexicons), lexicons[-1])
    base.remove_path(docs.sparkSession, rows.scratch)
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with score and predicted; columns of those names are replaced."""
    spark = docs.sparkSession
    base.small_batches(spark)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted")])
    shared = spark.sparkContext.broadcast(model)  # lexicon and trees, bounded by the sample
    position = [c.lower() for c in docs.columns].index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches):
        model = shared.value
        features = Features(model.lexicon if model.fitted else {})
        for batch in batches:
            s = model.score(batch.column(position).to_pylist(), features)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(base.lean(run), f"{schema}, score double, predicted int")
