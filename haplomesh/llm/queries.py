"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .bpe import round_trip
from .common import read_documents
from .exact_dedup import exact_dedup
from .license_scan import license_scan
from .mpegts import read_media, store_media
from .ngram_join import ngram_join
from .packing import pack_documents
from .pii import pii_report
from .suffix_dedup import suffix_dedup
from .token_codes import tokens_to_files
from .toxicity import toxicity
from .vocabulary import default_path


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_documents(spark, sf_dir))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_documents(spark, sf_dir))


def op3_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_to_files(read_documents(spark, sf_dir), default_path("byte_bpe_50k.json"), end_id=2)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(read_documents(spark, sf_dir), default_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read_documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_documents(spark, sf_dir), default_path("word_bpe_49k.json"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(read_documents(spark, sf_dir))


def op8_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(store_media(read_documents(spark, sf_dir)))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark, read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(read_documents(spark, sf_dir))


def queries() -> dict:
    found = [op1_exact_dedup, op2_license_scan, op3_token_codes, op4_byte_bpe, op5_suffix_dedup, op6_packing, op7_pii, op8_transport_stream, op9_toxicity, op10_ngram_join]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL}


OP1_SQL = r"""
WITH base AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
ranked AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM base)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked
"""
