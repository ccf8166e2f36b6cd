"""A training-corpus pipeline over ``documents``: quality, language, near-duplicates, contamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns what it keeps with the
columns of ``documents``; the last one returns pieces of sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odresil.llm import base, decontaminate, minmax, packing, ppm, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or the likelihood ratio between trusted and all documents.

    Null, empty and short texts fail; repeated rows and rows without an id are judged each; without labels only the base
    rules and a ratio of 0 decide; an empty table gives no rows."""
    return quality.fit_and_judge(docs, base.table(spark, sf_dir, "labels")).where("kept").select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those that no learned language codes clearly best and well.

    Each half of the documents is judged by what the other half teaches, so that no text is known to its judge.  Null
    texts go; rows without a language are judged but teach nothing; where a half teaches nothing the other half goes; a
    null id belongs to one of the halves; an empty table gives no rows."""
    half, kept = base.fold(F.col("doc_id"), 2), []
    for k in (0, 1):
        model, mine = ppm.train(docs, half != k), docs.where(half == k)
        bounds = ppm.limits(mine, model) if model else {}
        kept.append(ppm.judge(mine, model, bounds).where("accepted").select(*COLUMNS))
    return kept[0].unionByName(kept[1])


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates.

    Rows are linked by numbers of their own, so rows that share a doc_id or have none are rows like any others; texts
    without words resemble nothing and stay; an empty table gives no rows."""
    rows = base.written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")), "rows")
    found = minmax.link(rows.select(F.col("_row").alias("doc_id"), "text"))
    first = found.where("doc_id = component_id").select(F.col("doc_id").alias("_row"))
    return rows.join(first, "_row", "left_semi").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages; null texts and those without words stay; repeated rows are judged each;
    an empty benchmark leaves all, an empty table gives no rows."""
    return decontaminate.judged(docs, base.table(spark, sf_dir, "benchmark")).where("not contaminated").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens; a null text has its end id alone; an empty table gives no rows."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=False)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near-duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each one's rows are written to the shared folder and read by the next."""
    docs = base.table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = base.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
