"""Corpus pipeline: drop toxic documents, exact copies and near copies, redact personal data, pack.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor
kept and returns the columns of ``documents``; the last returns packed pieces.
Each row is decided by its own text: null and repeated ids are rows like others,
and extra columns pass through under whatever name. Null texts are empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haplomesh.llm.common import bound_batches, scratch
from haplomesh.llm.exact_dedup import keep_first
from haplomesh.llm.ngram_join import keep_one
from haplomesh.llm.packing import pack_documents
from haplomesh.llm.pii import redact
from haplomesh.llm.toxicity import drop_toxic as drop_toxic_rows
from haplomesh.llm.toxicity import fit
from haplomesh.llm.vocabulary import default_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is at least the threshold go."""
    bound_batches(spark)
    return drop_toxic_rows(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays: the longest original, then the smallest doc_id."""
    bound_batches(spark)
    return keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of five-word Jaccard similarity 0.8 or more connect, the row of the smallest doc_id stays."""
    bound_batches(spark)
    return keep_one(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the new text."""
    out = redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048 ids, as pieces."""
    bound_batches(spark)
    return pack_documents(docs, default_path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_join", drop_near_copies), ("pii", redact_pii), ("packing", pack)]

#: Scores, shingles and tokenisers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read back, and what the stage wrote besides goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
