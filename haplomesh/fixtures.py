"""Genotype tables derived from the driver's parquet tables, with the same definitions as SQL."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haplomesh.sources.vcf import numbered

DIMS, PER_CONTIG, STEP, MISSING = 62, 16, 1000, 0.0032


def hap_long(spark: SparkSession, sf: str, missing: bool = False) -> DataFrame:
    """One row per (variant, haplotype): allele 1 where three neighbouring dimensions sum above 0; 2 is missing."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("hap_idx"), "embedding")
    d = F.explode(F.sequence(F.lit(0), F.lit(DIMS - 1))).alias("d")
    x = e.select("hap_idx", "embedding", d)
    v = [F.get("embedding", F.col("d") + k).cast("double") for k in range(3)]
    allele = F.when(v[0] + v[1] + v[2] > 0, 1).otherwise(0)
    if missing:
        allele = F.when(F.abs(v[0]) < MISSING, 2).otherwise(allele)
    return x.select(
        F.col("d").cast("long").alias("variant_id"), F.floor(F.col("d") / PER_CONTIG).cast("int").alias("rid"), (F.col("d") * STEP).alias("pos"),
        F.floor(F.col("hap_idx") / 2).cast("int").alias("sample_id"), F.col("hap_idx").cast("int").alias("hap_idx"), allele.alias("allele"),
    )


BUCKET = 4096  # haplotypes that are packed together


def alleles_of(embedding: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """0/1 matrices of vectors by :data:`DIMS`: allele 1, and a first term under :data:`MISSING`; absent terms make neither."""
    n, width = len(embedding), DIMS + 2
    lengths = np.asarray(pc.fill_null(pc.list_value_length(embedding), 0), np.int64)
    flat = embedding.flatten()
    row = np.repeat(np.arange(n), lengths)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    near = col < width
    terms, known = np.zeros((n, width)), np.zeros((n, width), bool)
    known[row[near], col[near]] = np.asarray(flat.is_valid())[near]
    terms[row[near], col[near]] = np.asarray(pc.fill_null(flat.cast(pa.float64()), 0.0))[near]
    with np.errstate(invalid="ignore"):
        total = terms[:, :DIMS] + terms[:, 1 : DIMS + 1] + terms[:, 2:]
    alt = known[:, :DIMS] & known[:, 1 : DIMS + 1] & known[:, 2:] & ~(total <= 0)  # NaN is above every number, in Spark and in the twin
    return alt, known[:, :DIMS] & (np.abs(terms[:, :DIMS]) < MISSING)


def variants(spark: SparkSession, sf: str, missing: bool = False) -> DataFrame:
    """The variant table of :func:`hap_long`, bit-packed, in time and memory in proportion to the haplotypes.

    A vector is one word of its alleles, a bucket of neighbouring vectors is
    turned into bits by variant, and a variant's row joins its bits in order.
    """
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("hap_idx"), "embedding")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alt, gone = alleles_of(batch.column(1))
            alt, gone = (alt & ~gone, gone) if missing else (alt, np.zeros_like(gone))
            packed = [np.packbits(np.pad(m, ((0, 0), (0, 64 - DIMS))), axis=1, bitorder="little").view(np.int64).ravel() for m in (alt, gone)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p) for p in packed)], names=["hap_idx", "alt", "gone"])

    def turned(key: tuple[Any, ...], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames)).sort_values(["hap_idx", "alt"], kind="stable", na_position="first")
        by_variant = []
        for c in ("alt", "gone"):
            bits = np.unpackbits(pdf[c].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :DIMS].T
            by_variant.append([b.tobytes() for b in np.packbits(bits, axis=1, bitorder="little")])
        yield pd.DataFrame({"variant_id": np.arange(DIMS), "bucket": pd.array([None if pd.isna(key[0]) else key[0]] * DIMS, "Int64"), "n": len(pdf), "alt": by_variant[0], "gone": by_variant[1]})

    def joined(key: tuple[Any, ...], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames)).sort_values("bucket", na_position="first")
        row: dict[str, Any] = {"variant_id": key[0], "rid": key[0] // PER_CONTIG, "pos": key[0] * STEP, "n_haps": int(pdf.n.sum())}
        for c, name, count in (("alt", "hap_bits", "ac"), ("gone", "miss_bits", "n_missing")):
            bits = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n, bitorder="little") for b, n in zip(pdf[c], pdf.n)])
            row[name] = np.packbits(np.pad(bits, (0, -len(bits) % 64)), bitorder="little").view(np.int64)
            row[count] = int(bits.sum(dtype=np.int64))
        yield pd.DataFrame([row])

    coded = e.mapInArrow(words, "hap_idx long, alt long, gone long").withColumn("bucket", F.floor(F.col("hap_idx") / BUCKET))
    slices = coded.groupBy("bucket").applyInPandas(turned, "variant_id long, bucket long, n long, alt binary, gone binary")
    ddl = "variant_id long, rid int, pos int, n_haps int, hap_bits array<bigint>, miss_bits array<bigint>, ac int, n_missing int"
    return slices.groupBy("variant_id").applyInPandas(joined, ddl)


def rare_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Variants with 0 to 3 carriers: every variant's ALT alleles but for those on its first haplotypes go."""
    v = variants(spark, sf)
    words = F.transform("hap_bits", lambda w, i: F.when(i == 0, w.bitwiseAND(F.expr("shiftleft(1L, cast(variant_id % 6 as int)) - 1"))).otherwise(F.lit(0).cast("bigint")))
    v = v.withColumn("hap_bits", words)
    return v.withColumn("ac", F.aggregate(F.transform("hap_bits", lambda w: F.bit_count(w)), F.lit(0), lambda s, x: s + x))


def vcf_lines(spark: SparkSession, sf: str) -> DataFrame:
    """VCF text of the missing-data fixture, with some sites made multi-allelic, indels, haploid, invariant, repeated or led by a rejected record."""
    hap = hap_long(spark, sf, missing=True)
    code = F.when(F.col("allele") == 2, ".").otherwise(F.col("allele").cast("string"))
    gts = hap.withColumn("c", code).groupBy("variant_id", "rid", "pos", "sample_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("hap_idx", "c"))), lambda x: x["c"]), "|").alias("gt"))
    rows = gts.groupBy("variant_id", "rid", "pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("sample_id", "gt"))), lambda x: x["gt"]).alias("gts"))
    v = F.col("variant_id")
    alt = F.when(v % 13 == 12, "C,T").otherwise("C")
    ref = F.when(v % 17 == 16, "AC").otherwise("A")
    cells = F.when(v % 19 == 18, F.transform("gts", lambda g: F.substring(g, 1, 1))).when(v % 23 == 22, F.transform("gts", lambda g: F.lit("0|0"))).otherwise(F.col("gts"))

    def line(alt=alt):
        return F.concat_ws("\t", F.concat(F.lit("c"), "rid"), F.col("pos") + 1, F.lit("."), ref, alt, F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), F.array_join(cells, "\t"))

    body = rows.select((F.lit(100) + v * 4).alias("line"), line().alias("value"))
    again = rows.filter(v % 11 == 10).select((F.lit(101) + v * 4).alias("line"), line().alias("value"))
    # A record before its site's own that is rejected must not cost the site.
    first = rows.filter(v % 7 == 6).select((F.lit(99) + v * 4).alias("line"), line(F.lit("C,G")).alias("value"))
    head = spark.createDataFrame([(0, "##fileformat=VCFv4.2"), *[(i + 1, f"##contig=<ID=c{i},length=62000>") for i in range(4)]], "line long, value string")
    names = spark.read.parquet(f"{sf}/embeddings.parquet").agg(F.max("vec_id").alias("m")).select(
        F.lit(50).cast("long").alias("line"),
        F.concat(F.lit("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"), F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.col("m") / 2).cast("int")), lambda i: F.concat(F.lit("s"), i)), "\t")).alias("value"),
    )
    return head.unionByName(names).unionByName(body).unionByName(again).unionByName(first)


def contigs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, f"c{i}", 62_000) for i in range(4)], "contig_id int, contig string, n_bases long")


IDS = {f"c{i}": i for i in range(4)}


def carriers(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse fixture: an order carries the ALT allele of each of its parts."""
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_partkey").alias("variant_id"), F.col("l_orderkey").alias("hap_idx"))


def numbered_variants(spark: SparkSession, sf: str) -> DataFrame:
    """The dense fixture with ids by position bucket, as an import gives them."""
    v = variants(spark, sf).drop("variant_id").withColumn("ref", F.lit("A")).withColumn("alt", F.lit("C"))
    return numbered(v)


# -- the same tables in SQL ----------------------------------------------------
def hap_sql(missing: bool = False) -> str:
    v = [f"CAST(embedding[d + {k}] AS DOUBLE)" for k in (1, 2, 3)]
    allele = f"CASE WHEN {v[0]} + {v[1]} + {v[2]} > 0 THEN 1 ELSE 0 END"
    if missing:
        allele = f"CASE WHEN abs({v[0]}) < {MISSING} THEN 2 ELSE {allele} END"
    return f"""dims AS (SELECT unnest(range({DIMS})) AS d),
hap AS (SELECT d AS variant_id, d // {PER_CONTIG} AS rid, d * {STEP} AS pos, vec_id // 2 AS sample_id, vec_id AS hap_idx, {allele} AS allele
        FROM embeddings CROSS JOIN dims)"""


CELLS_SQL = """margin AS (SELECT variant_id, sum(CASE WHEN allele = 1 THEN 1 ELSE 0 END) AS ac, sum(CASE WHEN allele = 2 THEN 1 ELSE 0 END) AS miss FROM hap GROUP BY variant_id),
counted AS (SELECT a.variant_id AS va, b.variant_id AS vb, a.rid AS rid_a, a.pos AS pos_a, b.rid AS rid_b, b.pos AS pos_b,
  CAST(sum((1 - a.allele) * (1 - b.allele)) AS DOUBLE) AS ref_ref, CAST(sum((1 - a.allele) * b.allele) AS DOUBLE) AS ref_alt,
  CAST(sum(a.allele * (1 - b.allele)) AS DOUBLE) AS alt_ref, CAST(sum(a.allele * b.allele) AS DOUBLE) AS alt_alt
  FROM hap a JOIN hap b ON a.hap_idx = b.hap_idx AND a.variant_id < b.variant_id
  WHERE a.allele < 2 AND b.allele < 2 GROUP BY 1, 2, 3, 4, 5, 6),
cells AS (SELECT c.*, x.ac AS ac_a, y.ac AS ac_b, x.miss AS miss_a, y.miss AS miss_b
  FROM counted c JOIN margin x ON c.va = x.variant_id JOIN margin y ON c.vb = y.variant_id WHERE x.ac + y.ac > 2)"""

STATS_SQL = """freq AS (SELECT *, ref_ref + ref_alt + alt_ref + alt_alt AS n FROM cells),
marg AS (SELECT *, (ref_ref / n) * (alt_alt / n) - (ref_alt / n) * (alt_ref / n) AS d, (ref_ref + ref_alt) / n AS g0, (alt_ref + alt_alt) / n AS g1,
  (ref_ref + alt_ref) / n AS h0, (ref_alt + alt_alt) / n AS h1 FROM freq),
stat AS (SELECT *, d * d / (g0 * g1 * h0 * h1) AS r2,
  CASE WHEN d >= 0 THEN d / least(g0 * h1, h0 * g1) ELSE d / (-least(g0 * h0, g1 * h1)) END AS dprime FROM marg
  WHERE g0 * g1 * h0 * h1 > 0 AND n >= 5 AND n - greatest(ref_ref, alt_alt) >= 5 AND d <> 0),
ld1 AS (SELECT *, sqrt(r2) AS r, sign(d) * sqrt(r2) AS r_signed, n * r2 AS chisq_fisher, 0.0 AS chisq_model,
  1 + CASE WHEN rid_a = rid_b THEN 2 ELSE 0 END + CASE WHEN rid_a = rid_b AND abs(pos_b - pos_a) > 500000 THEN 4 ELSE 0 END
  + CASE WHEN least(ref_ref, ref_alt, alt_ref, alt_alt) < 1 THEN 8 ELSE 0 END + CASE WHEN r2 > 0.99 THEN 16 ELSE 0 END
  + CASE WHEN miss_a > 0 THEN 256 ELSE 0 END + CASE WHEN miss_b > 0 THEN 512 ELSE 0 END
  + CASE WHEN ac_a < 5 THEN 1024 ELSE 0 END + CASE WHEN ac_b < 5 THEN 2048 ELSE 0 END AS flag FROM stat)"""

FISHER_SQL = """tab AS (SELECT va, vb, CAST(ref_ref AS BIGINT) AS a, CAST(ref_ref + ref_alt AS BIGINT) AS rw, CAST(ref_ref + alt_ref AS BIGINT) AS cl, CAST(n AS BIGINT) AS n FROM ld1),
tabs AS (SELECT *, unnest(range(greatest(0, rw + cl - n), least(rw, cl) + 1)) AS i FROM tab),
lp AS (SELECT va, vb, a, i, -(lgamma(i + 1.0) + lgamma(rw - i + 1.0) + lgamma(cl - i + 1.0) + lgamma(n - rw - cl + i + 1.0)) AS l FROM tabs),
pk AS (SELECT va, vb, max(l) AS top, max(CASE WHEN i = a THEN l END) AS seen FROM lp GROUP BY va, vb),
pv AS (SELECT lp.va, lp.vb, least(1.0, sum(CASE WHEN exp(l - top) <= exp(seen - top) * 1.00000001 THEN exp(l - top) ELSE 0 END) / sum(exp(l - top))) AS p
  FROM lp JOIN pk ON lp.va = pk.va AND lp.vb = pk.vb GROUP BY lp.va, lp.vb)"""

MIRROR_SQL = """both_ways AS (
  SELECT flag, rid_a, pos_a, rid_b, pos_b, ref_ref, ref_alt, alt_ref, alt_alt, d, dprime, r, r2, {p} AS p, chisq_fisher, chisq_model FROM ld1 {join}
  UNION ALL
  SELECT flag, rid_b, pos_b, rid_a, pos_a, ref_ref, alt_ref, ref_alt, alt_alt, d, dprime, r, r2, {p} AS p, chisq_fisher, chisq_model FROM ld1 {join})"""


def cells_with(missing: bool = False) -> str:
    return f"WITH {hap_sql(missing)},\n{CELLS_SQL}"


def stats_with(missing: bool = False) -> str:
    return f"{cells_with(missing)},\n{STATS_SQL}"


def ld_with(exact_p: bool = False) -> str:
    """The mirrored pair table ``ld`` of the dense fixture."""
    mirror = MIRROR_SQL.format(p="pv.p", join="JOIN pv ON ld1.va = pv.va AND ld1.vb = pv.vb") if exact_p else MIRROR_SQL.format(p="NULL", join="")
    extra = f",\n{FISHER_SQL}" if exact_p else ""
    return f"{stats_with()}{extra},\n{mirror},\nld AS (SELECT * FROM both_ways)"
