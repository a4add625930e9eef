"""VCF text to the variant table: header, site filters, genotype summaries, bit packing, import report."""

from __future__ import annotations

import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haplomesh.functions.stats import hwe_column

# Reasons; the first is that of a record which passes all tests after another of its site.
REASONS = ["duplicate", "no_genotypes", "mixed_ploidy", "multiallelic", "not_snv", "missing", "few_samples", "invariant", "hwe"]


def read_lines(spark: SparkSession, path: str, split_bytes: int = 32 << 20) -> DataFrame:
    """Lines of a VCF file, plain or block-gzipped: ``value`` and ``line`` (an increasing number).

    Plain text is split by Spark. Block-gzipped files (``.gz``, ``.bgz``) are
    split too: a task finds the first block that begins in its range of bytes.
    """
    if not path.endswith((".gz", ".bgz")):
        return spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).getLen()
    cuts = [(path, at, min(at + split_bytes, size), k << 40) for k, at in enumerate(range(0, size, split_bytes))]
    ranges = spark.createDataFrame(cuts, "path string, low long, high long, first long").repartition(max(1, len(cuts)))

    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():
                at = r["first"]
                for lines in bgzf_lines(r["path"], r["low"], r["high"]):
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array(range(at, at + len(lines)), pa.int64())], names=["value", "line"])
                    at += len(lines)

    return ranges.mapInArrow(read, "value string, line long")


def next_block(data: bytes, at: int) -> tuple[int, int] | None:
    """(start, length) of the first whole block-gzip block of ``data`` from ``at`` on."""
    while (at := data.find(b"\x1f\x8b\x08\x04", at)) >= 0:
        if at + 18 <= len(data) and data[at + 10 : at + 16] == b"\x06\0BC\x02\0":
            return at, int.from_bytes(data[at + 16 : at + 18], "little") + 1
        at += 1
    return None


def bgzf_lines(path: str, low: int, high: int):
    """Lists of the lines that begin in the blocks that begin in [low, high); the last may end in a later block.

    The first line of a file belongs to its first range; a later range leaves
    out what stands before its first line end, which the range before reads.
    """
    store, name = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    whole, step = 1 << 16, 1 << 20
    with store.open_input_file(name) as src:
        size = src.size()
        rest, skip, at = b"", low > 0, low
        data = src.read_at(min(step, size - low), low) if size > low else b""
        done = False
        while not done:
            found = next_block(data, 0)
            if found and found[0] + found[1] > len(data) or not found and at + len(data) < size:  # read on
                more = src.read_at(min(step, size - at - len(data)), at + len(data))
                if not more:
                    break
                data += more
                continue
            if not found:
                break
            start, length = found
            own = at + start < high
            text = zlib.decompress(data[start + 18 : start + length - 8], -15)
            if not own:  # only the rest of the last line
                end = text.find(b"\n")
                done, text = end >= 0, text[: end + 1] if end >= 0 else text
            data, at = data[start + length :], at + start + length
            if skip:
                end = text.find(b"\n")
                if end < 0:
                    done = done or not own
                    continue
                text, skip = text[end + 1 :], False
                if not own:
                    break
            lines = (rest + text).split(b"\n")
            rest = lines.pop()
            if lines:
                yield [x.decode() for x in lines]
            if not own and not rest:
                break
        if rest:
            yield [rest.decode()]


def vcf_header(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contigs: contig_id, contig, n_bases; samples: sample_id, sample). Header lines are few."""
    head = lines.filter(F.col("value").startswith("##contig="))
    contigs = head.select(
        "line", F.regexp_extract("value", r"ID=([^,>]+)", 1).alias("contig"), F.regexp_extract("value", r"length=(\d+)", 1).try_cast("bigint").alias("n_bases")
    )
    contigs = contigs.withColumn("contig_id", F.row_number().over(W.orderBy("line")) - 1).select("contig_id", "contig", "n_bases")
    names = lines.filter(F.col("value").startswith("#CHROM")).select(F.posexplode(F.slice(F.split("value", "\t"), 10, 1 << 30)).alias("sample_id", "sample"))
    return contigs, names


def vcf_records(lines: DataFrame, contigs: DataFrame) -> DataFrame:
    """One row per record: rid, contig, pos (0-based), ref, alt, format, and the samples' genotype strings."""
    f = F.split("value", "\t")
    rows = lines.filter(~F.col("value").startswith("#") & (F.col("value") != "")).select(
        "line", f[0].alias("contig"), (f[1].cast("int") - 1).alias("pos"), f[3].alias("ref"), f[4].alias("alt"), f[8].alias("format"), F.slice(f, 10, 1 << 30).alias("columns")
    )
    rows = rows.withColumn("gts", F.transform("columns", lambda c: F.substring_index(c, ":", 1))).drop("columns")
    return rows.join(contigs.select("contig", F.col("contig_id").alias("rid")), "contig")


def genotype_summary(records: DataFrame) -> DataFrame:
    """Allele and genotype counts over the called diploid samples.

    A genotype string is read once, into a code: 0 to 3 for the called pairs
    0/0, 0/1, 1/0, 1/1, 4 for other called ones, -1 where an allele is missing
    and -2 where there are not two. Counts are of codes.
    """
    pair = F.transform("gts", lambda g: F.split(g, r"[/|]"))
    out = records.withColumn("has_gt", F.coalesce(F.col("format").startswith("GT"), F.lit(False))).withColumn("_pairs", pair)

    def code(p: Column) -> Column:
        a, b = F.get(p, F.lit(0)), F.get(p, F.lit(1))
        plain = a.isin("0", "1") & b.isin("0", "1")
        return F.when(F.size(p) != 2, -2).when((a == ".") | (b == "."), -1).when(plain, 2 * a.cast("int") + b.cast("int")).otherwise(4)

    out = out.withColumn("_codes", F.transform("_pairs", code))

    def count(k: int) -> Column:
        return F.size(F.filter("_codes", lambda c: c == k))

    out = out.withColumn("n_samples", F.size("gts")).withColumn("diploid", ~F.exists("_codes", lambda c: c == -2))
    out = out.withColumn("n_called", F.size(F.filter("gts", lambda g: ~g.contains("."))))
    for name, k in {"n_hom_ref": 0, "n_01": 1, "n_10": 2, "n_hom_alt": 3}.items():
        out = out.withColumn(name, count(k))
    out = out.withColumn("n_het", F.col("n_01") + F.col("n_10"))
    flat = F.flatten("_pairs")
    out = out.withColumn("ac", F.size(F.filter(flat, lambda a: a == "1"))).withColumn("n_missing", F.size(F.filter(flat, lambda a: a == ".")))
    return out.withColumn("phased", F.forall("gts", lambda g: g.contains("|")))


def judged(records: DataFrame, min_call_rate: float = 0.9, min_samples: int = 5, drop_invariant: bool = True, min_hwe: float = 0.0) -> DataFrame:
    """Records with ``reason``: the first failed test, or null for kept ones; genotypes bit-packed.

    One record of a site is kept: of those that pass every other test the first
    in file order. What meets at a site is the packed record, not its text.
    """
    out = genotype_summary(records)
    classes = F.greatest("n_hom_ref", "n_01", "n_10", "n_hom_alt")
    out = out.withColumn("hwe_p", hwe_column(F.col("n_hom_ref"), F.col("n_het"), F.col("n_hom_alt")))
    tests = [
        ~F.col("has_gt"), ~F.col("diploid"), F.col("alt").contains(","),
        ~(F.col("ref").rlike("^[ATGC]$") & F.col("alt").rlike("^[ATGC]$")),
        F.col("n_called") < min_call_rate * F.col("n_samples"), F.col("n_called") < min_samples,
        (classes == F.col("n_called")) & F.lit(drop_invariant), F.col("hwe_p") < min_hwe,
    ]
    out = out.withColumn("reason", F.coalesce(*[F.when(t, F.lit(r)) for t, r in zip(tests, REASONS[1:], strict=True)]))
    out = out.withColumn("_flat", F.flatten("_pairs")).withColumn("n_haps", F.size("_flat"))

    def packed(allele: str) -> Column:
        return pack_words(F.transform("_flat", lambda a: (a == allele).cast("int")))

    for name, allele in (("hap_bits", "1"), ("ref_bits", "0"), ("miss_bits", ".")):
        out = out.withColumn(name, packed(allele))
    out = out.drop("gts", "_pairs", "_codes", "_flat")
    rank = F.row_number().over(W.partitionBy("rid", "pos", F.col("reason").isNull()).orderBy("line"))
    out = out.withColumn("rank", rank)
    return out.withColumn("reason", F.when(F.col("reason").isNull() & (F.col("rank") > 1), REASONS[0]).otherwise(F.col("reason")))


def import_report(judged_records: DataFrame) -> DataFrame:
    return judged_records.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def pack_words(bits: Column) -> Column:
    """Array of bigint words of an array of 0/1, 64 a word; ``bits`` is made once, not once a word."""

    def word(held: Column, w: Column) -> Column:
        part = F.slice(held, w * 64 + 1, F.lit(64))
        return F.aggregate(F.transform(part, lambda b, i: F.call_function("shiftleft", b.cast("bigint"), i)), F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x))

    def words(held: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(held) - 1) / 64).cast("int")), lambda w: word(held, w))

    # An expression inside a lambda is evaluated at each call, a lambda's variable is not.
    return F.get(F.transform(F.array(bits), words), F.lit(0))


def import_variants(records: DataFrame, flip: bool = False, **tests) -> DataFrame:
    """Kept records as the variant table, with bit-packed haplotypes.

    ``flip`` recodes sites so that ALT is the minor allele. ``variant_id`` numbers
    the variants by (rid, pos) within a range partition; the ids grow with position.
    """
    out = judged(records, **tests).filter("reason IS NULL")
    out = out.withColumn("flipped", F.lit(flip) & (2 * F.col("ac") > F.col("n_haps") - F.col("n_missing")))
    out = out.withColumn("hap_bits", F.when(F.col("flipped"), F.col("ref_bits")).otherwise(F.col("hap_bits")))
    out = out.withColumn("ac", F.when(F.col("flipped"), F.col("n_haps") - F.col("n_missing") - F.col("ac")).otherwise(F.col("ac")))
    out = out.withColumn("n_hom_alt", F.when(F.col("flipped"), F.col("n_hom_ref")).otherwise(F.col("n_hom_alt")))
    new_ref, new_alt = F.when(F.col("flipped"), F.col("alt")).otherwise(F.col("ref")), F.when(F.col("flipped"), F.col("ref")).otherwise(F.col("alt"))
    out = out.withColumn("_ref", new_ref).withColumn("alt", new_alt).withColumn("ref", F.col("_ref"))
    out = out.withColumn("has_missing", F.col("n_missing") > 0)
    return numbered(out.select("rid", "contig", "pos", "ref", "alt", "ac", "n_missing", "n_het", "n_hom_alt", "hwe_p", "phased", "flipped", "has_missing", "n_haps", "hap_bits", "miss_bits"))


def numbered(variants: DataFrame) -> DataFrame:
    """Dense ``variant_id`` by (rid, pos, ref, alt): sizes of position buckets, then a rank inside each bucket."""
    v = variants.withColumn("_bucket", F.floor(F.col("pos") / 1_000_000))
    sizes = v.groupBy("rid", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(W.orderBy("rid", "_bucket").rowsBetween(W.unboundedPreceding, -1))).drop("_n")
    inside = F.row_number().over(W.partitionBy("rid", "_bucket").orderBy("pos", "ref", "alt")) - 1
    out = v.withColumn("_in", inside).join(before, ["rid", "_bucket"])
    return out.withColumn("variant_id", (F.coalesce("_before", F.lit(0)) + F.col("_in")).cast("long")).drop("_bucket", "_in", "_before")
