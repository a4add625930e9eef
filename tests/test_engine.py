"""LD engine: golden rows, hand cases, properties, and SQL twins on the smallest tables."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from haplomesh import fixtures as X
from haplomesh import queries as Q
from haplomesh.functions import stats as S
from haplomesh.operators import aggregate as A
from haplomesh.operators import extensions as E
from haplomesh.operators import pairs as P
from haplomesh.operators import reshape as R
from haplomesh.operators import view as V
from haplomesh.plans.planner import choose_kernel, compute_ld
from haplomesh.sources import store, vcf

from .compare import same, table

SF = "/root/testdata/sf0.001"

# Published rows (cells, D, D', R, R2, P, chi-squared).
GOLDEN = [
    ((4999, 6, 0, 3), 0.000597965, 1, 0.577004, 0.332934, 4.01511e-09, 1667.33),
    ((4421, 387, 82, 118), 0.0195352, 0.54402, 0.331324, 0.109775, 1.53587e-69, 549.755),
    ((1150, 1283, 388, 2187), 0.0804323, 0.509361, 0.348864, 0.121706, 1.17649e-138, 609.504),
    ((4988, 9, 5, 6), 0.0011915, 0.544089, 0.465743, 0.216917, 1.05037e-13, 1086.32),
    ((5000, 2, 4, 2), 0.000398404, 0.4994, 0.407677, 0.166201, 7.1708e-06, 832.333),
]


def cells(spark, rows):
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], "ref_ref double, ref_alt double, alt_ref double, alt_alt double")


def test_golden_rows(spark):
    got = S.with_fisher(S.with_ld_stats(cells(spark, [g[0] for g in GOLDEN]))).collect()
    for r, g in zip(got, GOLDEN, strict=True):
        for name, want in zip(("d", "dprime", "r", "r2", "p", "chisq_fisher"), g[1:], strict=True):
            assert r[name] == pytest.approx(want, rel=2e-5), (g[0], name)


def test_negative_d_both_bounds(spark):
    one = cells(spark, [(5000, 1000, 1000, 10)])
    a, b = S.with_ld_stats(one).head(), S.with_ld_stats(one, compat=True).head()
    assert a.d == pytest.approx(-0.0193325, rel=1e-5) and a.dprime == pytest.approx(0.931281, rel=1e-5)
    assert b.dprime == pytest.approx(0.156766, rel=1e-5) and a.r_signed < 0 < a.r


def test_degenerate_tables_are_dropped(spark):
    rows = [(10, 0, 0, 0), (4, 0, 0, 0), (25, 25, 25, 25), (90, 2, 2, 0), (90, 2, 2, 1)]
    got = np.array(rows, float).T
    assert S.usable_cells(*got, S.pair_statistics(*got)["d"]).sum() == 1
    assert [r.r2 for r in S.with_ld_stats(cells(spark, rows)).collect()][0] is None


def test_unphased_hand_table(spark):
    names = ", ".join(f"g{i}{j} double" for i in range(3) for j in range(3))
    rows = [(40.0, 20.0, 5.0, 22.0, 30.0, 9.0, 4.0, 10.0, 12.0)]
    f = np.array([0.5, 0.1, 0.15, 0.25])
    h = {(0, 0): f[0], (0, 1): f[1], (1, 0): f[2], (1, 1): f[3]}
    g = np.zeros((3, 3))
    for (a, b), x in h.items():
        for (c, d), y in h.items():
            g[a + c, b + d] += 1000 * x * y
    rows.append(tuple(g.ravel().tolist()))
    rows.append((0.0,) * 9)
    got = S.with_unphased_haplotypes(spark.createDataFrame(rows, names)).orderBy("individuals").collect()
    assert len(got) == 2
    assert got[0].f11 == pytest.approx(0.4837344526, rel=1e-8) and got[0].chisq_model == pytest.approx(6.6581036817, rel=1e-8)
    assert got[1].f11 == pytest.approx(0.5, rel=1e-6) and got[1].chisq_model == pytest.approx(0, abs=1e-6)


def test_hwe_and_fisher_edges():
    assert S.hwe_exact(np.array([0, 10, 5]), np.array([0, 0, 10]), np.array([0, 0, 5]))[:2].tolist() == [1.0, 1.0]
    assert S.hwe_exact(np.array([50]), np.array([0]), np.array([50]))[0] < 1e-20
    assert S.fisher_two_sided(*(np.array([x]) for x in (5, 0, 3, 0)))[0] == 1.0


def random_variants(spark, v=24, haps=40, missing=False, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(v):
        a = rng.choice(3 if missing else 2, haps, p=[0.5, 0.4, 0.1] if missing else [0.6, 0.4]).tolist()
        rows.append((k, k // 9, 100 * k, a))
    df = spark.createDataFrame(rows, "variant_id long, rid int, pos int, a array<int>")
    out = df.select("variant_id", "rid", "pos", F.size("a").alias("n_haps"), F.size(F.filter("a", lambda x: x == 1)).alias("ac"), F.size(F.filter("a", lambda x: x == 2)).alias("n_missing"),
                    vcf.pack_words(F.transform("a", lambda x: (x == 1).cast("int"))).alias("hap_bits"), vcf.pack_words(F.transform("a", lambda x: (x == 2).cast("int"))).alias("miss_bits"))
    return out, np.array([r[3] for r in rows])


def brute_cells(x):
    out = {}
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            ok = (x[i] < 2) & (x[j] < 2)
            out[i, j] = tuple(int((ok & (x[i] == a) & (x[j] == b)).sum()) for a in (0, 1) for b in (0, 1))
    return out


@pytest.mark.parametrize("missing", [False, True])
def test_dense_kernel_against_brute_force(spark, missing):
    v, x = random_variants(spark, missing=missing)
    got = {(r.variant_id_a, r.variant_id_b): tuple(int(r[c]) for c in Q.CELLS) for r in P.pair_cells(v, block=5).collect()}
    assert got == brute_cells(x)


@pytest.mark.parametrize("missing", [False, True])
@pytest.mark.parametrize("model", ["phased", "unphased", "auto"])
def test_cells_over_spans_of_haplotypes(spark, missing, model):
    """Summed over spans of 64 haplotypes, the last of them odd in number, the cells are those of one matrix."""
    v, x = random_variants(spark, haps=203, missing=missing)
    got = {(r.variant_id_a, r.variant_id_b): r for r in P.pair_cells(v, model=model, block=5, span=400).collect()}
    if model != "unphased":
        assert {k: tuple(int(r[c]) for c in Q.CELLS) for k, r in got.items()} == brute_cells(x)
    if model != "phased":
        y = np.pad(x, ((0, 0), (0, 1)))
        dose = np.where((y[:, 0::2] == 2) | (y[:, 1::2] == 2), -1, y[:, 0::2] + y[:, 1::2])
        for (i, j), r in got.items():
            assert [r[c] for c in P.NINE] == [((dose[i] == a) & (dose[j] == b)).sum() for a in range(3) for b in range(3)]


def test_packing_words_takes_linear_time(spark):
    """The array is made once and not once a word: 400,000 calls of the inner function here, 2.5 billion before."""
    n = 400_000
    made = spark.range(1).select(vcf.pack_words(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: (k % 3 == 0).cast("int"))).alias("w"))
    began = time.time()
    words = made.head()[0]
    assert time.time() - began < 30
    bits = np.unpackbits(np.array(words, np.int64).view(np.uint8), bitorder="little")
    assert len(words) == n // 64 and (bits == (np.arange(1, n + 1) % 3 == 0)).all()


@pytest.mark.parametrize("missing", [False, True])
def test_variants_are_packed_from_vectors_in_any_order(spark, tmp_path, missing):
    """Ids over several buckets, absent and NaN terms: the alleles of the long table, and no row holds a variant's haplotypes but as bits."""
    rng = np.random.default_rng(5)
    rows = [(int(k), rng.normal(size=64).round(2).tolist(), 0) for k in rng.permutation(9001)[:700] * 3]
    rows[3] = (rows[3][0], None, 0)
    rows[4][1][9], rows[4][1][30], rows[4][1][50:52] = None, float("nan"), [float("inf"), float("-inf")]
    rows[5] = (rows[5][0], rows[5][1][:20], 0)
    rows[6] = (rows[6][0], [0.0] * 64, 0)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    table = X.variants(spark, str(tmp_path), missing)
    assert "collect_list" not in table._jdf.queryExecution().toString()
    want: dict[int, list] = {}
    for r in X.hap_long(spark, str(tmp_path), missing).orderBy("variant_id", "hap_idx").collect():
        want.setdefault(r.variant_id, []).append(r.allele)
    got = {r.variant_id: r for r in table.collect()}
    assert set(got) == set(want)
    for k, r in got.items():
        a = np.array(want[k])
        assert (r.rid, r.pos, r.n_haps, r.ac, r.n_missing) == (k // 16, 1000 * k, 700, (a == 1).sum(), (a == 2).sum())
        for words, allele in ((r.hap_bits, 1), (r.miss_bits, 2)):
            bits = np.unpackbits(np.array(words, np.int64).view(np.uint8), bitorder="little")
            assert len(words) == 11 and (bits[:700] == (a == allele)).all() and not bits[700:].any()


def test_window_is_exact_at_its_edge(spark):
    v, x = random_variants(spark)
    got = {(r.variant_id_a, r.variant_id_b) for r in P.pair_cells(v, window=300, block=4, side=2).collect()}
    assert got == {(i, j) for i in range(24) for j in range(i + 1, 24) if i // 9 == j // 9 and j - i <= 3}


def test_chunks_partition_all_pairs(spark):
    v, x = random_variants(spark)
    every = [tuple(r) for c in range(6) for r in P.pair_cells(v, block=5, chunk=(6, c)).select("variant_id_a", "variant_id_b").collect()]
    assert len(every) == len(set(every)) == 24 * 23 // 2
    with pytest.raises(ValueError):
        P.pair_cells(v, block=5, chunk=(4, 0))


def test_region_clamp_and_errors(spark):
    v, x = random_variants(spark)
    assert P.target_region(v, 0, 1, 150, flank=500).count() == 1 + 2 * 5
    with pytest.raises(ValueError):
        P.target_region(v, 0, 100_000, 200_000)
    with pytest.raises(ValueError):
        P.target_region(v.filter("variant_id = 0"), 0, 1, 150)


def test_auto_model_and_mirror(spark):
    v, x = random_variants(spark, missing=True)
    got = compute_ld(v, model="auto", min_r2=0.0, block=8)
    assert got.count() == 2 * got.filter("pos_a < pos_b").count()
    back = got.select(*[F.col(a).alias(b) for a, b in (("pos_a", "pos_b"), ("pos_b", "pos_a"), ("ref_alt", "alt_ref"), ("alt_ref", "ref_alt"), ("r2", "r2"))])
    assert got.select("pos_a", "pos_b", "ref_alt", "alt_ref", "r2").exceptAll(back.select("pos_a", "pos_b", "ref_alt", "alt_ref", "r2")).isEmpty()


def test_planner_choice(spark):
    v, _ = random_variants(spark)
    assert choose_kernel(v) == "dense" and choose_kernel(v.withColumn("ac", F.lit(0))) == "sparse"


def test_interval_strings():
    ids = {"6": 5, "chr1": 0, "chr2": 1}
    assert V.parse_interval("6", ids)[0] == V.Interval("6")
    assert V.parse_interval("6:100", ids)[0] == V.Interval("6", 100, 100)
    assert V.parse_interval("6:1.5e6-2e6", ids)[0] == V.Interval("6", 1_500_000, 2_000_000)
    assert V.parse_interval("chr1,chr2", ids)[1] == V.Interval("chr2")
    for bad in ("", "6,6,6", "6:1e10-2e10", "7:1-2", "6:9-3"):
        with pytest.raises(ValueError):
            V.parse_interval(bad, ids)


def test_prune_of_a_long_chain_against_a_loop(spark):
    rng = np.random.default_rng(5)
    links = {(k, k + 1) for k in range(5000)} | {(int(a), int(a + b)) for a, b in zip(rng.integers(0, 4900, 3000), rng.integers(1, 90, 3000))}
    kept, by = [], {}
    for a, b in links:
        by.setdefault(b, set()).add(a)
    seen = set()
    for v in range(5001):
        if not by.get(v, set()) & seen:
            kept.append(v)
            seen.add(v)
    pairs = spark.createDataFrame([(0, a, b, 0.5) for a, b in links], "rid_a int, variant_id_a long, variant_id_b long, r2 double")
    got = E.ld_prune(spark.range(5001).withColumnRenamed("id", "variant_id"), pairs, 0.1)
    assert sorted(r[0] for r in got.collect()) == kept


def test_tiles_are_bounded_by_count_in_a_dense_window(spark):
    """Thousands of variants in one window: no frame of more than a block's pairs, and tiles of bounded sides."""
    v = spark.range(3000).select(F.col("id").alias("variant_id"), F.lit(0).alias("rid"), (F.col("id") / 10).cast("int").alias("pos"), F.lit(64).alias("n_haps"), F.lit(20).alias("ac"), F.lit(0).alias("n_missing"),
                                 F.array(F.xxhash64("id")).alias("hap_bits"), F.array(F.lit(0).cast("long")).alias("miss_bits"))
    tiles = P.tiled(v, block=100, window=1000, side=4).groupBy("x", "y").agg(F.countDistinct("variant_id").alias("n")).agg(F.max("n")).head()[0]
    assert tiles == 800
    assert P.pair_cells(v, block=100, window=1000, side=4, skip_rare=False).count() == 3000 * 2999 // 2
    assert P.pair_cells(v, block=100, side=7, skip_rare=False).count() == 3000 * 2999 // 2
    one = v.filter("variant_id < 300")
    assert P.pair_cells(one, block=100, window=5).count() == sum(1 for i in range(300) for j in range(i) if i // 10 - j // 10 <= 5)


def test_r2_ceiling_loses_no_pair(spark):
    v, x = random_variants(spark, v=40)
    v = v.withColumn("hap_bits", F.when(F.col("variant_id") % 3 == 0, F.transform("hap_bits", lambda w: w.bitwiseAND(7))).otherwise(F.col("hap_bits")))
    v = v.withColumn("ac", F.aggregate(F.transform("hap_bits", lambda w: F.bit_count(w)), F.lit(0), lambda s, y: s + y))
    every = compute_ld(v, model="phased", min_r2=0.0, exact_p=False, mirror=False, block=8).filter("r2 >= 0.2")
    some = compute_ld(v, model="phased", min_r2=0.2, exact_p=False, mirror=False, block=8)
    assert sorted(map(tuple, every.select("pos_a", "pos_b").collect())) == sorted(map(tuple, some.select("pos_a", "pos_b").collect()))


def test_exact_tests_against_loops():
    from math import comb

    rng = np.random.default_rng(8)
    t = rng.integers(0, 30, (4, 300))
    got = S.fisher_two_sided(*t)
    for k, (w, x, y, z) in enumerate(t.T.tolist()):
        row, col, n = w + x, w + y, w + x + y + z
        prob = {i: comb(row, i) * comb(n - row, col - i) for i in range(max(0, row + col - n), min(row, col) + 1)}
        assert got[k] == pytest.approx(sum(p for p in prob.values() if p <= prob[w]) / sum(prob.values()), rel=1e-6)
    a, h, b = rng.integers(0, 25, (3, 200))
    for k, p in enumerate(S.hwe_exact(a, h, b)):
        n, rare = int(a[k] + h[k] + b[k]), int(2 * min(a[k], b[k]) + h[k])
        prob = {i: 2**i * comb(n, (rare - i) // 2) * comb(n - (rare - i) // 2, i) for i in range(rare % 2, rare + 1, 2)}
        assert p == pytest.approx(sum(q for q in prob.values() if q <= prob[int(h[k])]) / sum(prob.values()), rel=1e-6)


def bgzf(data, size):
    import zlib

    out = b""
    for at in range(0, len(data), size):
        part = data[at : at + size]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + (len(body) + 25).to_bytes(2, "little") + body + zlib.crc32(part).to_bytes(4, "little") + len(part).to_bytes(4, "little")
    return out + bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


@pytest.mark.parametrize("size, split", [(700, 500), (700, 1 << 20), (65_000, 3000), (40, 64)])
def test_block_gzip_file_equals_its_text(spark, tmp_path, size, split):
    rng = np.random.default_rng(1)
    lines = ["#" + "x" * int(n) + str(k) for k, n in enumerate(rng.integers(0, 300, 400))]
    path = tmp_path / "a.vcf.gz"
    path.write_bytes(bgzf(("\n".join(lines) + "\n").encode(), size))
    got = vcf.read_lines(spark, str(path), split).orderBy("line").collect()
    assert [r.value for r in got] == lines


def test_import_keeps_a_site_after_a_rejected_record(spark):
    rows = ["##contig=<ID=1,length=100>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\tc\td\te"]
    site = lambda alt, *g: "\t".join(["1", "7", ".", "A", alt, ".", ".", ".", "GT:DP", *[f"{x}:3" for x in g]])
    rows += [site("C,T", *["0|1"] * 5), site("C", "0|1", "0|0", "1|1", "0|1", "0/0"), site("G", "0|1", "0|0", "1|1", "0|1", "0|0")]
    lines = spark.createDataFrame(list(enumerate(rows)), "line long, value string")
    contigs, names = vcf.vcf_header(lines)
    report = {r.reason: r.n for r in vcf.import_report(vcf.judged(vcf.vcf_records(lines, contigs))).collect()}
    assert report == {"multiallelic": 1, "kept": 1, "duplicate": 1}
    kept = vcf.import_variants(vcf.vcf_records(lines, contigs)).collect()
    assert [(r.pos, r.alt, r.ac, r.phased, r.hap_bits) for r in kept] == [(6, "C", 4, False, [0b0010110010])]


def test_relationship_with_missing_alleles(spark):
    v, x = random_variants(spark, v=30, haps=12, missing=True)
    got = {(r.s1, r.s2): r.ibs for r in A.relationship(v.repartition(3)).collect()}
    dose = np.where((x[:, 0::2] == 2) | (x[:, 1::2] == 2), -1, (x[:, 0::2] == 1) * 1 + (x[:, 1::2] == 1))
    for a in range(6):
        for b in range(6):
            both = (dose[:, a] >= 0) & (dose[:, b] >= 0)
            p, q = dose[both, a], dose[both, b]
            score = np.where((p == q) & (p != 1), 2, np.where(abs(p - q) == 2, 0, 1)).sum() / (2 * both.sum())
            assert got[a, b] == pytest.approx(1.0 if a == b else score)


@pytest.mark.parametrize("haps", [203, 36])
def test_relationship_in_tiles(spark, haps):
    """Beyond some samples no task holds the matrix: the tiles give the same rows, each once, also with an odd haplotype at the end."""
    v, _ = random_variants(spark, v=70, haps=haps, missing=True)
    whole = {(r.s1, r.s2): r.ibs for r in A.relationship(v).collect()}
    tiles = A.relationship(v.repartition(3), tile=16, most=8)
    got = [tuple(r) for r in tiles.collect()]
    samples = (haps + 1) // 2
    assert len(got) == len(whole) == samples * samples and {(a, b): i for a, b, i in got} == whole
    tile = tiles.select((F.least("s1", "s2") / 16).cast("int").alias("x"), (F.greatest("s1", "s2") / 16).cast("int").alias("y"), F.spark_partition_id().alias("task"))
    assert tile.groupBy("x", "y").agg(F.countDistinct("task").alias("n")).filter("n > 1").isEmpty()
    assert tile.select("task").distinct().count() > 1


def test_no_query_outgrows_the_compiler(spark):
    """The generated code of the pair queries is compiled: what would be too large falls back with a log line and runs interpreted."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        for name in ("ld_all_pairs", "fisher_exact", "ld_flags", "ld_auto", "agg_raster_r2"):
            plan = Q.QUERIES[name](spark, SF)
            code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(plan._jdf.queryExecution().executedPlan())
            for k in range(code.size()):
                assert code.apply(k)._3().maxMethodCodeSize() < 65_535
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_raster_reads_its_input_twice_at_most(spark):
    t = Q.pair_table(spark, SF)
    plan = A.raster(t, X.contigs(spark), 40, 40)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_concat_checks_samples(spark):
    t = cells(spark, [(1, 2, 3, 4)])
    with pytest.raises(ValueError):
        R.ld_concat([t], [["a"]])
    with pytest.raises(ValueError):
        R.ld_concat([t, t], [["a"], ["b"]])


def test_raster_toy(spark):
    rows = [(0, 0, 4 * x + y, 0, 250 * x, 250 * y, float(4 * x + y + 1)) for x in range(4) for y in range(4)]
    t = spark.createDataFrame(rows, "rid_a int, rid_b int, flag int, z int, pos_a int, pos_b int, r2 double")
    t = t.withColumns({c: F.lit(1.0) for c in Q.CELLS + ["r", "d", "dprime", "p"]})
    names = spark.createDataFrame([(0, "c", 1000)], "contig_id int, contig string, n_bases long")
    with pytest.raises(ValueError):
        A.raster(t, names, 2, 2)
    got = A.raster(t, names, 5, 5, "r2", "total", 0)
    assert got.agg(F.sum("value")).head()[0] == sum(range(1, 17))


def test_headers_go_along(spark, tmp_path):
    names, samples = X.contigs(spark), spark.createDataFrame([(0, "s0")], "sample_id int, sample string")
    t = Q.pair_table(spark, SF)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    for path, some in ((a, "rid_a = 0"), (b, "rid_a > 0")):
        store.write_ld(t.filter(some), path)
        store.write_sidecar(spark, path, names, samples, "calc -p")
    rows, header = store.open_table(spark, a)
    assert header["commands"] == ["calc -p"] and len(header["contigs"]) == 4 and rows.count() == t.filter("rid_a = 0").count()
    assert R.concat_files(spark, [a, b]).count() == t.count()
    store.write_sidecar(spark, b, names, spark.createDataFrame([(0, "other")], "sample_id int, sample string"), "calc")
    with pytest.raises(ValueError):
        R.concat_files(spark, [a, b])
    with pytest.raises(ValueError):
        store.open_raster(spark, a)


def test_streaming_view(spark, tmp_path):
    from haplomesh.streaming.incremental import ld_stream, stream_decay, stream_view

    t = Q.ld(spark, SF)
    t.write.parquet(str(tmp_path / "in"))
    s = stream_view(ld_stream(spark, str(tmp_path / "in"), t.schema), ranges={"r2": (0.05, None)})
    q = stream_decay(s, 10_000, 10).writeStream.outputMode("complete").format("memory").queryName("decay_now").start()
    q.processAllAvailable()
    q.stop()
    want = t.filter("r2 >= 0.05 AND rid_a = rid_b AND pos_a < pos_b").count()
    assert spark.sql("SELECT sum(frequency) FROM decay_now").head()[0] == want


def test_empty_variants(spark):
    v, _ = random_variants(spark)
    assert P.pair_cells(v.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_sql_twin(spark, name):
    import duckdb

    df = Q.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("embeddings", "lineitem", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    res = con.sql(Q.SQL[name])
    assert sorted(df.columns) == sorted(res.columns)
    mine = table([tuple(r) for r in df.collect()], df.columns)
    assert mine and same(mine, table(res.fetchall(), res.columns)) == ""
