"""Quality rules in DataFrame expressions alone: base rules, then a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into ``BUCKETS`` buckets.  Two multinomials over the buckets, one of trusted target
documents and one of all documents, are counted with partial aggregation.  A document's score is the mean over its
n-grams of ln(p_target / p_raw), so long and short documents compare; documents with a score below the threshold are
rejected.

Documents fall into ``FOLDS`` folds by a hash of their id, and the target of a fold comes from the trusted documents of
the others.  So no trusted document is known to its judge, and trusted and other documents are judged alike.  The
threshold is the score that ``REJECTED`` of the trusted documents stay below.  The verdict depends on the two tables
only and is the same at every run.

The target is every trusted document and the raw counts cover every document.  Trusted ids are joined as masks of 64 ids
a row, so Spark can broadcast them up to many millions and deals both sides by key beyond that.  The driver gathers the
counts, ``BUCKETS`` rows for each fold and the rest, and the bins in which the threshold's quantile is looked for.

Cases: null and wordless texts have no words, fail the base rules and get a null score; very long texts are read whole;
a score equal to the threshold is kept; repeated rows are judged each for itself, and those of one doc_id in one fold; a
null doc_id is never trusted and has a fold of its own; without trusted documents, or on an empty table, every weight and
the threshold are zero; other columns are kept (columns named like a result are replaced; names that begin with ``_qr_``
are taken).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

BUCKETS, FOLDS, REJECTED = 1 << 15, 5, 0.002
WHITE = "[\\\\x20\\\\x09-\\\\x0D]+"
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")


def with_words(docs: DataFrame) -> DataFrame:
    """Adds ``_qr_w``, the words of the text, and ``_qr_h``, their hashes."""
    docs = docs.withColumn("_qr_w", F.expr(f"array_remove(split(coalesce(text, ''), '{WHITE}'), '')"))
    return docs.withColumn("_qr_h", F.expr("transform(_qr_w, x -> xxhash64(x))"))


def base_columns(docs: DataFrame) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, from ``_qr_w`` and ``_qr_h``."""
    docs = docs.withColumn("_qr_g", F.expr("if(size(_qr_h) < 5, array(), transform(sequence(0, size(_qr_h) - 5), i -> xxhash64(_qr_h[i], _qr_h[i + 1], _qr_h[i + 2], _qr_h[i + 3], _qr_h[i + 4])))"))
    docs = docs.withColumn("_qr_l", F.expr("filter(split(coalesce(text, ''), '\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"))
    # windows found twice: their starts in order; each adds the words that the one before does not cover
    docs = docs.withColumn("_qr_s", F.expr("if(size(array_distinct(_qr_g)) = size(_qr_g), array(), array_sort(transform(_qr_g, (g, i) -> struct(g as g, i as i))))"))
    docs = docs.withColumn("_qr_t", F.expr("if(size(_qr_s) = 0, array(), array_sort(transform(filter(_qr_s, (x, k) -> x.g <=> get(_qr_s, k - 1).g or x.g <=> get(_qr_s, k + 1).g), x -> x.i)))"))
    return docs.withColumns(
        {
            "n_words": F.expr("cast(size(_qr_w) as bigint)"),
            "word_chars": F.expr("cast(char_length(array_join(_qr_w, '')) as bigint)"),
            "n_symbols": F.expr("cast(char_length(coalesce(text, '')) - char_length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]+', '')) as bigint)"),
            "n_dup_lines": F.expr("cast(size(_qr_l) - size(array_distinct(_qr_l)) as bigint)"),
            "n_repeat_words": F.expr("cast(aggregate(transform(_qr_t, (x, k) -> coalesce(least(5, get(_qr_t, k + 1) - x), 5)), 0, (a, x) -> a + x) as bigint)"),
        }
    ).drop("_qr_g", "_qr_l", "_qr_s", "_qr_t")


def grams(buckets: int) -> str:
    """The buckets of a document's words and word pairs, from ``_qr_h``, as an expression."""
    one = f"transform(_qr_h, x -> cast(pmod(x, {buckets}) as int))"
    two = f"transform(sequence(0, size(_qr_h) - 2), i -> cast(pmod(xxhash64(_qr_h[i], _qr_h[i + 1]), {buckets}) as int))"
    return f"concat({one}, if(size(_qr_h) < 2, array(), {two}))"


def fold_of(folds: int) -> str:
    """The fold of a document, from its id."""
    return f"cast(pmod(xxhash64(doc_id), {folds}) as int)"


def marked(docs: DataFrame, trusted: DataFrame, how: str) -> DataFrame:
    """``docs`` with ``_id``, the doc_id where it is trusted, else null; an inner join leaves the trusted ones."""
    masks = trusted.select(F.shiftright("doc_id", 6).alias("_block"), F.expr("shiftleft(1L, cast(doc_id & 63 as int))").alias("_bit"))
    masks = base.written(masks.groupBy("_block").agg(F.bit_or("_bit").alias("_mask")), "masks")  # of a size that Spark knows
    rows = docs.withColumn("_block", F.shiftright("doc_id", 6)).join(masks, "_block", how)
    rows = rows.withColumn("_id", F.expr("if(getbit(_mask, cast(doc_id & 63 as int)) = 1, doc_id, null)")).drop("_block", "_mask")
    return rows.where("_id is not null") if how == "inner" else rows


def bucket_counts(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, folds: int = 1) -> DataFrame:
    """(bucket, k, n): n-grams of the trusted documents of each fold k, and of all others (k null)."""
    words = with_words(marked(docs.select("doc_id", "text"), trusted, "left"))
    rows = words.select(F.explode(F.expr(grams(buckets))).alias("bucket"), F.expr(f"if(_id is null, null, {fold_of(folds)})").alias("k"))
    return rows.groupBy("bucket", "k").agg(F.count("*").alias("n"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids labelled as of good quality, all of them."""
    return labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def fit_weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, folds: int = 1) -> DataFrame:
    """(place, weight): ln(p_target / p_raw) of each bucket, for each fold in turn; all zero without target n-grams.

    With several folds, those of a fold come from the trusted documents of the other folds, so a document never meets
    weights that its own text has shaped.  The target multinomial is smoothed by ``buckets`` draws from the raw one, so a
    weight does not depend on how much larger the corpus is than its trusted part, and tends to zero where that part
    says little."""
    found = bucket_counts(docs, trusted, buckets, folds).select("bucket", F.coalesce("k", F.lit(folds)).alias("k"), "n")
    rows = found.toArrow()  # at most buckets * (folds + 1) rows of three numbers
    counts = np.zeros((folds + 1, buckets))
    counts[rows["k"].to_numpy(), rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    raw, target, out = counts.sum(0), counts[:folds], []
    for k in range(folds):
        t = target.sum(0) - target[k] if folds > 1 else target[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            w = np.log((t * raw.sum() / raw + buckets) / (t.sum() + buckets))
        out.append(np.where((raw > 0) & (t.sum() > 0), w, 0.0))
    return as_table(docs.sparkSession, np.concatenate(out))


def as_table(spark: SparkSession, weights) -> DataFrame:
    """Weights in turn as a written table (place, weight)."""
    weights = np.asarray(weights, float)
    rows = pa.table({"place": pa.array(np.arange(len(weights), dtype=np.int32)), "weight": pa.array(weights)})
    return base.written(spark.createDataFrame(rows), "weights")


def fit(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """Weights and threshold of a corpus and its labels."""
    trusted = base.written(trusted_ids(labels), "trusted")
    weights = fit_weights(docs, trusted, folds=FOLDS)
    return weights, fit_threshold(docs, trusted, weights, FOLDS)


def with_llr(words: DataFrame, weights: DataFrame, folds: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``llr``, the mean weight of a document's n-grams, from ``_qr_h`` and ``_qr_f``, its fold; null without words.

    The weights, ``buckets`` for each fold, reach the tasks as the value of a scalar subquery, with all their digits."""
    listed = weights.agg(F.array_sort(F.collect_list(F.struct("place", "weight"))).alias("all"))
    table = listed.select(F.expr("transform(all, x -> x.weight)").alias("table")).scalar()
    place = f"i + {buckets} * _qr_f" if folds > 1 else "i"
    total = f"aggregate({grams(buckets)}, 0D, (a, i) -> a + _qr_table[{place}])"
    mean = F.expr(f"if(size(_qr_h) = 0, cast(null as double), {total} / (2 * size(_qr_h) - 1))")
    return words.withColumn("_qr_table", table).withColumn("llr", mean).drop("_qr_table")


def fit_threshold(docs: DataFrame, trusted: DataFrame, weights: DataFrame, folds: int, share: float = REJECTED) -> float:
    """The score that the share ``share`` of the trusted documents stay below, each scored without its own fold; 0 if there
    are none.  It follows from the tables alone: the exact quantile of all trusted documents' scores."""
    words = with_words(marked(docs.select("doc_id", "text"), trusted, "inner")).withColumn("_qr_f", F.expr(fold_of(folds)))
    rows = with_llr(words, weights, folds).select("llr", F.size("_qr_h").alias("n_words"))
    return threshold_of(rows, share)


def threshold_of(rows: DataFrame, share: float = REJECTED) -> float:
    """The quantile of ``llr`` over rows (llr, n_words) of trusted documents; those of fewer than ten words do not count."""
    values = rows.where("n_words >= 10").select(F.lit("").alias("key"), F.col("llr").alias("value"))
    return base.quantiles(base.written(values, "scores"), share).get("", 0.0)


def scored(docs: DataFrame, weights: DataFrame, folds: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with the columns of ``RESULTS`` except the verdict."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in RESULTS])
    fold = F.expr(fold_of(folds)) if folds > 1 else F.lit(0)
    out = with_llr(base_columns(with_words(docs.withColumn("_qr_f", fold))), weights, folds, buckets).drop("_qr_f", "_qr_w", "_qr_h")
    return out.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))


def with_verdict(rows: DataFrame, threshold: float) -> DataFrame:
    """Adds ``kept`` to scored rows."""
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def judge(docs: DataFrame, weights: DataFrame, threshold: float, folds: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with the columns of ``RESULTS``."""
    return with_verdict(scored(docs, weights, folds, buckets), threshold)


def fit_and_judge(docs: DataFrame, labels: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """``judge`` by what ``fit`` learns of the same documents, each scored once: the scores are written, without the columns
    ``without``, and the threshold is taken from the written ones."""
    trusted = base.written(trusted_ids(labels), "trusted")
    weights = fit_weights(docs, trusted, folds=FOLDS)
    rows = base.written(scored(docs, weights, FOLDS).drop(*without), "judged")
    return with_verdict(rows, threshold_of(marked(rows.select("doc_id", "llr", "n_words"), trusted, "inner")))
