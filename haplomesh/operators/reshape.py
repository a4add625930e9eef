"""Sorting, joining files, and haplotype extraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haplomesh.sources.store import read_sidecar

ORDER = ["rid_a", "rid_b", "pos_a", "pos_b"]


def ld_sort(ld: DataFrame) -> DataFrame:
    """Total order; a range exchange and a spilling sort."""
    return ld.orderBy(*ORDER)


def ld_concat(parts: list[DataFrame], samples: list[list[str]]) -> DataFrame:
    """Rows of two or more tables over the same samples."""
    if len(parts) < 2:
        raise ValueError("concatenation takes two tables or more")
    if any(s != samples[0] for s in samples[1:]):
        raise ValueError("the tables have different samples")
    return reduce(DataFrame.unionByName, parts)


def concat_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of the stored tables, whose headers must name the same samples; one scan of all files."""
    names = [[s["sample"] for s in read_sidecar(spark, p)["samples"]] for p in paths]
    if len(paths) < 2:
        raise ValueError("concatenation takes two tables or more")
    if any(n != names[0] for n in names[1:]):
        raise ValueError("the tables have different samples")
    return spark.read.parquet(*paths)


def haplotype_rows(hap: DataFrame, numeric: bool = False) -> DataFrame:
    """One base string per haplotype from (variant_id, pos, hap_idx, allele, ref, alt): variants in order of position."""
    code = F.when(F.col("allele") == 0, F.lit("0") if numeric else F.col("ref")).when(F.col("allele") == 1, F.lit("1") if numeric else F.col("alt")).otherwise(F.lit("2") if numeric else F.lit("N"))
    rows = hap.withColumn("base", code).groupBy("hap_idx").agg(F.sort_array(F.collect_list(F.struct("variant_id", "base"))).alias("s"))
    return rows.select("hap_idx", F.array_join(F.transform("s", lambda x: x["base"]), "").alias("sequence"))


def haplotype_fasta(hap: DataFrame, numeric: bool = False) -> DataFrame:
    """FASTA records: name ``sample_k`` and sequence."""
    rows = haplotype_rows(hap, numeric)
    return rows.select(F.concat(F.lit(">"), F.floor(F.col("hap_idx") / 2), F.lit("_"), F.col("hap_idx") % 2).alias("name"), "sequence")


def haplotype_matrix(hap: DataFrame, positions: list[int]) -> DataFrame:
    """A row per haplotype and a column per position (named from 1)."""
    wide = hap.groupBy("hap_idx").pivot("pos", positions).agg(F.first("allele"))
    return wide.select("hap_idx", *[F.col(str(p)).alias(f"p{p + 1}") for p in positions])
