"""The corpus queries, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, conversations, ctw, html, linejoin, packing, permutation, pii, quality, simhash, substrings, telephony
from .common import documents


def op1_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_report(documents(spark, sf_dir))


def op2_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.text_clips(documents(spark, sf_dir))


def op3_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.train_and_score(documents(spark, sf_dir))


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation.nearest_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_report(documents(spark, sf_dir))


def op7_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.held_out_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linejoin.line_report(documents(spark, sf_dir))


def op10_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeat_report(documents(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_report(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


#: Windows of 35 words counted as hashes; a word goes if one of the windows that hold it occurs twice.
OP10 = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
x AS (SELECT doc_id, p, w[p] AS word, CASE WHEN p + 34 <= len(w) THEN md5(array_to_string(w[p:p + 34], ' ')) END AS h FROM t),
r AS (SELECT h FROM x WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
c AS (SELECT x.doc_id, p, word, max(CASE WHEN r.h IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY x.doc_id ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM x LEFT JOIN r ON x.h = r.h)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d
LEFT JOIN (SELECT doc_id, sum(gone) AS n, string_agg(word, ' ' ORDER BY p) FILTER (gone = 0) AS k FROM c GROUP BY doc_id) USING (doc_id)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op10_fm_index": OP10}
