"""The corpus pipeline: each stage works on all that its predecessor kept, and its decisions take effect.

Documents that the quality classifier rejects go; lines that match earlier ones go; of each group of
near-duplicates the document with the smallest id stays; personal data is replaced by its kind; what is left is
packed. n_chars follows the text.

Every stage takes null and repeated ids, null and empty texts, repeated rows, empty tables and further columns, and
keeps the columns of its input (the last one gives pieces).
"""

from __future__ import annotations

import public_tokenizers
from flowlens.llm import linejoin, packing, pii, quality, simhash
from flowlens.llm.common import fold, fresh, materialise
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _as_before(docs: DataFrame, now: DataFrame) -> DataFrame:
    """now with the columns of docs, n_chars counted anew."""
    return now.select(*(F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more. Without labels that may be learned from every score is 0.5, and all stay;
    null and empty texts have a score like any other."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels.where(fold("doc_id", 3) != 1))
    score = fresh(docs, "_quality")
    return quality.score(docs, model, to=score).where(F.col(score) >= 0.5).drop(score)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that match an earlier one; a document may become empty, but stays."""
    return _as_before(docs, linejoin.dedup_lines(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near copies, the one with the smallest id. Rows are told apart by all their columns,
    so of different texts under one id or under none only near copies go; texts without words are copies of each other."""
    return simhash.representatives(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; null texts become empty."""
    return _as_before(docs, pii.redact(docs, pii.train(docs)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place; null and empty texts hold the end token alone."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]
#: SQL can't express the classifier, the random field or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
