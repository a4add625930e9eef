"""Aggregations over the pair table and the sample relationship matrix."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haplomesh.operators.pairs import unpack

CELLS = ["ref_ref", "ref_alt", "alt_ref", "alt_alt"]


def value_of(name: str) -> Column:
    """What a raster aggregates; names as on the command line, in any case."""
    total = sum((F.col(c) for c in CELLS), F.lit(0.0))
    table = {
        "r2": F.col("r2"), "r": F.col("r"), "d": F.col("d"), "dprime": F.col("dprime"), "dp": F.col("dprime"), "p": F.col("p"),
        "hets": (F.col("ref_alt") + F.col("alt_ref")) / total, "het": (F.col("ref_alt") + F.col("alt_ref")) / total,
        "alts": F.col("alt_alt") / total, "alt": F.col("alt_alt") / total,
    }
    return table[name.lower()]


def reduced(name: str, v: Column, cutoff: int = 0) -> Column:
    """Aggregate of a cell; 0 under ``cutoff`` records (mean, count, sd) or under that total."""
    n = F.count(v)
    table = {
        "mean": F.when(n >= cutoff, F.avg(v)).otherwise(0.0), "count": F.when(n >= cutoff, n).otherwise(0).cast("double"),
        "n": F.when(n >= cutoff, n).otherwise(0).cast("double"), "sd": F.when(n >= cutoff, F.stddev_pop(v)).otherwise(0.0),
        "min": F.min(v), "max": F.max(v), "total": F.when(F.sum(v) >= cutoff, F.sum(v)).otherwise(0.0),
        "total2": F.sum(v * v),
    }
    return table[name.lower()]


def landscape(ld: DataFrame) -> DataFrame:
    """Per contig, the least and largest position of both sides."""
    sides = ld.select(F.explode(F.array(F.struct(F.col("rid_a").alias("rid"), F.col("pos_a").alias("pos")), F.struct(F.col("rid_b").alias("rid"), F.col("pos_b").alias("pos")))).alias("s"))
    return sides.groupBy(F.col("s.rid").alias("rid")).agg(F.min("s.pos").alias("min_pos"), F.max("s.pos").alias("max_pos"))


def offsets(ld: DataFrame, contigs: DataFrame) -> DataFrame:
    """Per present contig its first place on the joint axis and its span. One contig spans its records alone."""
    land = landscape(ld).join(contigs.select(F.col("contig_id").alias("rid"), "n_bases"), "rid")
    every = W.partitionBy()  # as many rows as contigs
    single = F.count(F.lit(1)).over(every) == 1
    land = land.withColumn("span", F.when(single, F.col("max_pos") - F.col("min_pos") + 1).otherwise(F.col("n_bases")))
    land = land.withColumn("first", F.when(single, F.col("min_pos")).otherwise(F.lit(0)))
    before = F.coalesce(F.sum("span").over(W.orderBy("rid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return land.withColumn("offset", before).select("rid", "offset", "first", "span")


def raster(ld: DataFrame, contigs: DataFrame, x_bins: int = 1000, y_bins: int = 1000, value: str = "r2", reduce: str = "mean", cutoff: int = 1) -> DataFrame:
    """Sparse pixel matrix: x_bin, y_bin, value, n.

    Two passes over ``ld``, a stored table: the landscape, a row per contig,
    which becomes literals, and one aggregate.
    """
    if x_bins < 5 or y_bins < 5:
        raise ValueError("a raster has 5 bins a side at least")
    axis = offsets(ld, contigs).collect()  # a row per contig of the header
    span = sum(r.span for r in axis) or 1
    bpx, bpy = -(-span // x_bins), -(-span // y_bins)

    def place(side: str) -> Column:
        table = [F.lit(x) for r in axis for x in (r.rid, r.offset - r["first"])]
        base = F.element_at(F.create_map(*table), F.col(f"rid_{side}")) if axis else F.lit(0)
        return base + F.col(f"pos_{side}")

    x, y = F.floor(place("a") / bpx).cast("int"), F.floor(place("b") / bpy).cast("int")
    v = value_of(value)
    return ld.groupBy(x.alias("x_bin"), y.alias("y_bin")).agg(reduced(reduce, v, cutoff).alias("value"), F.count(F.lit(1)).alias("n"))


def matrix_text(cells: DataFrame, bins: int) -> DataFrame:
    """Dense rows of a raster as tab-separated text: line number and text; values as their shortest decimal form."""
    rows = cells.groupBy("x_bin").agg(F.map_from_entries(F.collect_list(F.struct("y_bin", "value"))).alias("m"))
    every = cells.sparkSession.range(bins).select(F.col("id").cast("int").alias("x_bin"))
    line = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda y: F.coalesce(F.element_at("m", y), F.lit(0.0)).cast("string"))
    return every.join(rows, "x_bin", "left").select("x_bin", F.array_join(line, "\t").alias("line"))


def r2_histogram(ld: DataFrame) -> DataFrame:
    return ld.groupBy(F.floor(F.col("r2") * 100 + 1e-9).cast("int").alias("bin")).agg(F.sum("r2").alias("total"), F.count(F.lit(1)).alias("n"))


def flag_counts(ld: DataFrame) -> DataFrame:
    bits = F.filter(F.sequence(F.lit(0), F.lit(15)), lambda b: F.call_function("shiftright", F.col("flag"), b).bitwiseAND(1) == 1)
    return ld.select(F.explode(bits).alias("bit")).groupBy("bit").agg(F.count(F.lit(1)).alias("n"))


def cell_histogram(ld: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("cell"), F.col(c).cast("int").alias("value")) for c in CELLS])
    return ld.select(F.explode(pairs).alias("s")).groupBy(F.col("s.cell").alias("cell"), F.col("s.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def contig_matrix(ld: DataFrame) -> DataFrame:
    return ld.groupBy("rid_a", "rid_b").agg(F.count(F.lit(1)).alias("n"))


def decay(ld: DataFrame, span: int = 1_000_000, bins: int = 100) -> DataFrame:
    """Mean R2 by distance within contigs; the last bin takes everything beyond; empty bins have frequency 0."""
    width = span // bins
    near = ld.filter((F.col("rid_a") == F.col("rid_b")) & (F.col("pos_a") < F.col("pos_b")))
    k = F.least(F.floor((F.col("pos_b") - F.col("pos_a")) / width), F.lit(bins - 1)).cast("int")
    found = near.groupBy(k.alias("bin")).agg(F.avg("r2").alias("mean_r2"), F.count(F.lit(1)).alias("frequency"))
    every = ld.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = every.join(found, "bin", "left")
    return out.select((F.col("bin") * width).alias("from_bp"), ((F.col("bin") + 1) * width).alias("to_bp"), F.coalesce("mean_r2", F.lit(0.0)).alias("mean_r2"), F.coalesce("frequency", F.lit(0)).cast("long").alias("frequency"))


def decay_positional(ld: DataFrame) -> DataFrame:
    """Per A position, how many later partners on the contig and their mean distance."""
    near = ld.filter((F.col("rid_a") == F.col("rid_b")) & (F.col("pos_a") < F.col("pos_b")))
    return near.groupBy("rid_a", "pos_a").agg(F.count(F.lit(1)).alias("n"), (F.avg("pos_b") - F.col("pos_a")).alias("mean_distance"))


TILE_SAMPLES = 512  # samples on a side of a tile of the relationship matrix
MOST_IN_TASK = 2048  # samples of which a task may hold the whole matrix
PAIRS_OF_TASK = 1 << 22


def _scores(planes_a, planes_b) -> tuple[np.ndarray, np.ndarray]:
    """Sums over variants of 2 - |difference| and of both called, for each sample of one side with each of the other."""
    (side_a, ok_a), (side_b, ok_b) = planes_a, planes_b
    both = ok_a.T @ ok_b
    return both + side_a.T @ side_b, both  # 2 for the same homozygote, 0 for opposite ones, 1 for the rest


def _planes(bits: np.ndarray, miss: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per variant and sample -1, 0 or 1 for REF/REF, heterozygote and ALT/ALT, and whether both alleles are called (then else 0)."""
    ok = (miss[:, 0::2] | miss[:, 1::2]) == 0
    side = (bits[:, 0::2].astype(np.int8) + bits[:, 1::2].astype(np.int8) - 1) * ok
    return side.astype(np.float32), ok.astype(np.float32)


def _sums_in_tasks(variants: DataFrame, ddl: str) -> DataFrame:
    """Half a matrix a task, summed: for samples of which a task can hold the whole matrix."""

    def partial(frames):
        score = called = None
        for pdf in frames:
            haps = int(pdf.n_haps.max())
            haps += haps % 2  # an odd last haplotype is a sample's whole dose; words have room for its pair
            bits, miss = unpack(pdf.hap_bits, haps), unpack(pdf.miss_bits, haps)
            for at in range(0, len(pdf), 512):
                planes = _planes(bits[at : at + 512], miss[at : at + 512])
                gain, both = (m.astype(np.float64) for m in _scores(planes, planes))
                score, called = (gain, both) if score is None else (score + gain, called + both)
        if score is not None:
            for s in range(len(score)):
                yield pd.DataFrame({"s1": s, "s2": np.arange(s, len(score)), "score": score[s, s:], "called": called[s, s:]})

    return variants.mapInPandas(partial, ddl).groupBy("s1", "s2").agg(F.sum("score").alias("score"), F.sum("called").alias("called"))


def _sums_in_tiles(variants: DataFrame, samples: int, tile: int, ddl: str) -> DataFrame:
    """Tiles of two blocks of samples: a task holds one tile's sums, and of some variants at once the bits of its two blocks."""
    width, blocks = tile // 4, -(-samples // tile)  # two haplotypes a sample, eight a byte

    def deal(frames):
        for pdf in frames:
            for at in range(0, len(pdf), 64):
                part = pdf[at : at + 64]
                rows = []
                for words in (part.hap_bits, part.miss_bits):
                    grid = np.stack([np.asarray(w, np.int64) for w in words]).view(np.uint8)
                    full = np.zeros((len(part), blocks * width), np.uint8)
                    full[:, : grid.shape[1]] = grid[:, : full.shape[1]]
                    rows.append([full[:, b * width : (b + 1) * width].tobytes() for b in range(blocks)])
                bits, miss = rows
                for y in range(blocks):
                    yield pd.DataFrame({"x": np.arange(y + 1), "y": y, "bits_x": bits[: y + 1], "miss_x": miss[: y + 1], "bits_y": bits[y], "miss_y": miss[y]})

    def kernel(key: tuple[Any, ...], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y = key
        score = called = 0.0

        def planes(bits: bytes, miss: bytes):
            return _planes(*(np.unpackbits(np.frombuffer(b, np.uint8).reshape(-1, width), axis=1, bitorder="little") for b in (bits, miss)))

        for pdf in frames:
            for r in pdf.itertuples():
                left = planes(r.bits_x, r.miss_x)
                gain, both = _scores(left, left if x == y else planes(r.bits_y, r.miss_y))
                score, called = score + gain.astype(np.float64), called + both.astype(np.float64)
        keep = np.ones(score.shape, bool)
        keep[max(0, samples - x * tile) :] = False  # beyond the last sample
        keep[:, max(0, samples - y * tile) :] = False
        i, j = np.nonzero(np.triu(keep) if x == y else keep)
        yield pd.DataFrame({"s1": i + x * tile, "s2": j + y * tile, "score": score[i, j], "called": called[i, j]})

    dealt = variants.mapInPandas(deal, "x int, y int, bits_x binary, miss_x binary, bits_y binary, miss_y binary")
    # As many tasks as the output needs: what is dealt is far smaller than what comes of it.
    tasks = max(variants.sparkSession.sparkContext.defaultParallelism, -(-samples * samples // (2 * PAIRS_OF_TASK)))
    return dealt.repartition(min(tasks, blocks * (blocks + 1) // 2), "x", "y").groupBy("x", "y").applyInPandas(kernel, ddl)


def relationship(variants: DataFrame, tile: int = TILE_SAMPLES, most: int = MOST_IN_TASK) -> DataFrame:
    """Sample-by-sample identity by state of bit-packed variants: 1 - |difference| / 2, over the variants both have called.

    Up to ``most`` samples a task sums matrix products over all its variants, so
    what is shuffled is a half matrix a task, whatever the number of variants.
    Beyond, the matrix is cut into tiles of ``tile`` samples a side (a multiple
    of 4), and a task holds one tile. Two heterozygotes count one half, as other
    unequal pairs of neighbours do; the diagonal is 1.
    """
    ddl = "s1 int, s2 int, score double, called double"
    samples = ((variants.agg(F.max("n_haps")).head()[0] or 0) + 1) // 2
    packed = variants.select("n_haps", "hap_bits", "miss_bits")
    sums = _sums_in_tasks(packed, ddl) if samples <= most else _sums_in_tiles(packed, samples, tile, ddl)
    sums = sums.filter("s1 = s2 OR called > 0")
    ibs = F.when(F.col("s1") == F.col("s2"), 1.0).otherwise(F.col("score") / (2 * F.nullif(F.col("called"), F.lit(0.0))))
    sides = F.when(F.col("s1") == F.col("s2"), F.array(F.struct("s1", "s2"))).otherwise(F.array(F.struct("s1", "s2"), F.struct(F.col("s2").alias("s1"), F.col("s1").alias("s2"))))
    return sums.select(F.explode(sides).alias("s"), ibs.alias("ibs")).select("s.s1", "s.s2", "ibs")
