"""Writing and reading the engine's tables: Parquet with a JSON sidecar, LD text and JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_COLUMNS = [
    "flag", "contig_a", "pos_a", "contig_b", "pos_b", "ref_ref", "ref_alt", "alt_ref", "alt_alt",
    "d", "dprime", "r", "r2", "p", "chisq_fisher", "chisq_model",
]


def write_variants(variants: DataFrame, path: str, parts: int | None = None) -> None:
    """Range-partitioned and sorted by position, so that row-group statistics prune intervals."""
    keys = ["rid", "pos"]
    dealt = variants.repartitionByRange(parts, *keys) if parts else variants.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_ld(ld: DataFrame, path: str, by_position: bool = True) -> None:
    """``by_position`` sorts by (rid_a, rid_b, pos_a, pos_b), which later slices prune on."""
    keys = ["rid_a", "rid_b", "pos_a", "pos_b"]
    out = ld.repartitionByRange(*keys).sortWithinPartitions(*keys) if by_position else ld
    out.write.mode("overwrite").option("compression", "zstd").parquet(path)


def with_names(ld: DataFrame, contigs: DataFrame) -> DataFrame:
    """Contig names of both sides; the contig table is the header's, a few rows."""
    out = ld
    for s in "ab":
        out = out.join(contigs.select(F.col("contig_id").alias(f"rid_{s}"), F.col("contig").alias(f"contig_{s}")), f"rid_{s}")
    return out


def ld_text(ld: DataFrame, contigs: DataFrame) -> DataFrame:
    """Human-readable columns, positions from 1."""
    out = with_names(ld, contigs).withColumn("pos_a", F.col("pos_a") + 1).withColumn("pos_b", F.col("pos_b") + 1)
    return out.select(*TEXT_COLUMNS)


def write_ld_text(ld: DataFrame, contigs: DataFrame, path: str, header: bool = True) -> None:
    ld_text(ld, contigs).write.mode("overwrite").csv(path, sep="\t", header=header)


def ld_json(ld: DataFrame, digits: int = 6) -> DataFrame:
    """One JSON array a row: flag, ids, positions from 1, cells, D, D', R, R2, P and both chi-squared values.

    Numbers have ``digits`` decimals; an absent value is null.
    """
    whole = [F.col("flag"), F.col("rid_a"), F.col("pos_a") + 1, F.col("rid_b"), F.col("pos_b") + 1]
    real = ["ref_ref", "ref_alt", "alt_ref", "alt_alt", "d", "dprime", "r", "r2", "p", "chisq_fisher", "chisq_model"]
    parts = [c.cast("string") for c in whole] + [F.round(c, digits).cast(f"decimal(30,{digits})").cast("string") for c in real]
    return ld.select(F.concat(F.lit("["), F.concat_ws(",", *[F.coalesce(c, F.lit("null")) for c in parts]), F.lit("]")).alias("json"))


def write_sidecar(spark: SparkSession, path: str, contigs: DataFrame, samples: DataFrame, command: str, before: list[str] = (), sorted_by: list[str] = ()) -> None:
    """Header and provenance beside a table, one JSON line: contigs, samples, commands in order, sort columns."""
    meta = {"contigs": [r.asDict() for r in contigs.orderBy("contig_id").collect()], "samples": [r.asDict() for r in samples.orderBy("sample_id").collect()]}
    meta |= {"commands": [*before, command], "sorted_by": list(sorted_by)}
    write_meta(spark, path, meta)


def write_meta(spark: SparkSession, path: str, meta: dict) -> None:
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_header")


def read_sidecar(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/_header").head()[0])


def open_table(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """A stored table with its header: rows are read lazily, the header at once."""
    return spark.read.parquet(path), read_sidecar(spark, path)


def derive(table: DataFrame, header: dict, path: str, command: str, by_position: bool = False) -> None:
    """Write what a command made of a table, with the table's header and one more line of provenance."""
    write_ld(table, path, by_position)
    order = ["rid_a", "rid_b", "pos_a", "pos_b"] if by_position else []
    write_meta(table.sparkSession, path, header | {"commands": [*header["commands"], command], "sorted_by": order})


def write_raster(cells: DataFrame, path: str, **settings) -> None:
    """A raster's cells, with what made it (bins, value, reduction, range) beside them."""
    cells.write.mode("overwrite").option("compression", "zstd").parquet(path)
    write_meta(cells.sparkSession, path, {"raster": settings})


def open_raster(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Cells and settings of a stored raster; another table is an error."""
    meta = read_sidecar(spark, path)
    if "raster" not in meta:
        raise ValueError(f"{path} holds no raster")
    return spark.read.parquet(path), meta["raster"]


def header_rows(contigs: DataFrame) -> DataFrame:
    """The header alone, as text lines."""
    return contigs.select(F.format_string("##contig=<ID=%s,length=%d>", "contig", "n_bases").alias("line"))
