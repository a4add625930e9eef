"""Operations that the original documents without code: pruning, association join, summaries, normalised rasters."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ld_prune(variants: DataFrame, pairs: DataFrame, min_r2: float, by: str = "rid_a") -> DataFrame:
    """Greedy pruning: variants in order of ``variant_id`` stay unless linked (r2 >= min_r2) to one that stays.

    ``pairs`` has each pair in one direction (variant_id_a < variant_id_b) with
    r2, and no link leaves a group of ``by`` (a contig). The order decides, so a
    group is one pass over its links, sorted by the later variant and streamed:
    its task holds the numbers of the dropped variants and nothing else. A chain
    of any length takes the same one pass.
    """
    links = pairs.filter(F.col("r2") >= min_r2).select(F.col(by).alias("part"), F.col("variant_id_a").cast("long").alias("a"), F.col("variant_id_b").cast("long").alias("b"))
    dealt = links.repartition("part").sortWithinPartitions("part", "b", "a")

    def walk(batches):
        part, dropped = None, set()
        for batch in batches:
            out = []
            for p, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part:
                    part, dropped = p, set()
                if b not in dropped and a not in dropped:  # every link of a to earlier variants has been seen
                    dropped.add(b)
                    out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["variant_id"])

    goes = dealt.mapInArrow(walk, "variant_id long")
    return variants.select("variant_id").join(goes, "variant_id", "left_anti")


def gwas_join(ld: DataFrame, gwas: DataFrame) -> DataFrame:
    """Partners' association strength beside their R2 with the target: joined on contig and position."""
    g = gwas.select(F.col("rid").alias("rid_b"), F.col("pos").alias("pos_b"), F.col("p").alias("p_gwas"))
    return ld.join(g, ["rid_b", "pos_b"]).withColumn("minus_log10_p", -F.log10("p_gwas"))


def numeric_summary(ld: DataFrame, columns: list[str], exact: bool = False) -> DataFrame:
    """Least, quartiles, mean and largest value of each column; ``exact`` quartiles hold a column's distinct values in one task."""
    quantile = F.percentile if exact else F.percentile_approx
    stacked = ld.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s"))
    v = F.col("s.v")
    return stacked.groupBy(F.col("s.name").alias("name")).agg(
        F.min(v).alias("least"), quantile(v, F.lit(0.25)).alias("q1"), quantile(v, F.lit(0.5)).alias("median"), F.avg(v).alias("mean"), quantile(v, F.lit(0.75)).alias("q3"), F.max(v).alias("largest")
    )


def quantile_raster(cells: DataFrame) -> DataFrame:
    """Raster values as their percent rank: the share of other cells that are less.

    Cells are counted by value first, so what is ranked in one task is the
    distinct values, by their counts, and not the cells.
    """
    counts = cells.groupBy("value").agg(F.count(F.lit(1)).alias("_k"))
    below = F.coalesce(F.sum("_k").over(W.orderBy("value").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.select(F.col("value").alias("_v"), below.alias("_below"), F.sum("_k").over(W.partitionBy()).alias("_all"))
    share = F.when(F.col("_all") > 1, F.col("_below") / (F.col("_all") - 1)).otherwise(0.0)
    return cells.join(ranked, F.col("value").eqNullSafe(F.col("_v"))).withColumn("rank", share).drop("_v", "_below", "_all")
