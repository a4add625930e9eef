"""Pair records that arrive in files: filters and running decay sums over Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haplomesh.operators.view import view


def ld_stream(spark: SparkSession, path: str, schema: T.StructType, files_a_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def stream_view(ld: DataFrame, **filters) -> DataFrame:
    """The same filters as on a table: they have no state."""
    return view(ld, **filters)


def stream_decay(ld: DataFrame, span: int = 1_000_000, bins: int = 100) -> DataFrame:
    """Running sum and count of R2 a distance bin; the state has ``bins`` rows."""
    width = span // bins
    near = ld.filter((F.col("rid_a") == F.col("rid_b")) & (F.col("pos_a") < F.col("pos_b")))
    k = F.least(F.floor((F.col("pos_b") - F.col("pos_a")) / width), F.lit(bins - 1)).cast("int")
    return near.groupBy(k.alias("bin")).agg(F.sum("r2").alias("total"), F.count(F.lit(1)).alias("frequency"))
