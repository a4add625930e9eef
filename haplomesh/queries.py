"""Named queries over the derived fixtures, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haplomesh import fixtures as X
from haplomesh.functions.stats import with_ld_stats, with_unphased_haplotypes
from haplomesh.operators import aggregate as A
from haplomesh.operators import extensions as E
from haplomesh.operators import pairs as P
from haplomesh.operators import reshape as R
from haplomesh.operators import view as V
from haplomesh.plans.planner import compute_ld, r2_bound
from haplomesh.session import shared_folder
from haplomesh.sources import store, vcf

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


STAT = ["d", "dprime", "r", "r2", "chisq_fisher"]
IDS = ["rid_a", "pos_a", "rid_b", "pos_b"]
CELLS = ["ref_ref", "ref_alt", "alt_ref", "alt_alt"]


def show(df: DataFrame, plain: list[str], doubles: list[str] = ()) -> DataFrame:
    """Whole numbers as they are, doubles to six digits."""
    return df.select(*[F.col(c).cast("long").alias(c) for c in plain], *[F.round(c, 6).alias(c) for c in doubles])


def shown(plain: list[str], doubles: list[str] = ()) -> str:
    return ", ".join([f"CAST({c} AS BIGINT) AS {c}" for c in plain] + [f"round({c}, 6) AS {c}" for c in doubles])


def dense(spark: SparkSession, sf: str, missing: bool = False, **kw) -> DataFrame:
    return P.pair_cells(X.variants(spark, sf, missing), block=16, **kw)


def ld(spark: SparkSession, sf: str, exact_p: bool = False, **kw) -> DataFrame:
    return compute_ld(X.variants(spark, sf), model="phased", min_r2=0.0, exact_p=exact_p, block=16, **kw)


def _stored(s: SparkSession, df: DataFrame, write) -> DataFrame:
    path = shared_folder(s, "table")
    write(df, path)
    return s.read.parquet(path)


_TABLES: dict[tuple, str] = {}


def pair_table(s: SparkSession, d: str, exact_p: bool = False) -> DataFrame:
    """The mirrored pair table as a stored one, sorted by position: what views, aggregates and sinks read. Written once an application."""
    key = (s.sparkContext.applicationId, d, exact_p)
    if key not in _TABLES:
        path = shared_folder(s, "ld")
        store.write_ld(ld(s, d, exact_p), path)
        _TABLES[key] = path
    return s.read.parquet(_TABLES[key])


# -- pairs ---------------------------------------------------------------------
LD1 = [*IDS, *CELLS]


@query("ld_all_pairs", f"{X.stats_with()} SELECT {shown(LD1, STAT)} FROM ld1 WHERE r2 >= 0.1")
def _(s, d):
    return show(compute_ld(X.variants(s, d), model="phased", min_r2=0.1, exact_p=False, mirror=False, block=16), LD1, STAT)


RARE_SQL = f"""WITH {X.hap_sql()}, m AS (SELECT variant_id AS v, rid, pos, CAST(sum(CASE WHEN hap_idx < variant_id % 6 THEN allele ELSE 0 END) AS BIGINT) AS ac FROM hap GROUP BY variant_id, rid, pos)
SELECT CAST(a.rid AS BIGINT) AS rid_a, CAST(a.pos AS BIGINT) AS pos_a, CAST(b.rid AS BIGINT) AS rid_b, CAST(b.pos AS BIGINT) AS pos_b, a.ac AS ac_a, b.ac AS ac_b FROM m a JOIN m b ON a.v < b.v WHERE a.ac + b.ac > 2"""


@query("skip_rare_pairs", RARE_SQL)
def _(s, d):
    return show(P.pair_cells(X.rare_variants(s, d), block=16), [*IDS, "ac_a", "ac_b"])


@query("ld_window", f"{X.stats_with()} SELECT {shown(LD1, STAT)} FROM ld1 WHERE rid_a = rid_b AND pos_b - pos_a BETWEEN 0 AND 2000")
def _(s, d):
    return show(compute_ld(X.variants(s, d), model="phased", min_r2=0.0, exact_p=False, mirror=False, window=2000), LD1, STAT)


@query("ld_target_region", f"{X.cells_with()} SELECT {shown(LD1)} FROM cells WHERE rid_a = 1 AND rid_b = 1 AND (pos_a + 1 BETWEEN 20000 AND 22500 OR pos_b + 1 BETWEEN 20000 AND 22500) AND pos_a + 1 BETWEEN 17000 AND 25500 AND pos_b + 1 BETWEEN 17000 AND 25500")
def _(s, d):
    return show(P.target_region(X.variants(s, d), 1, 20_000, 22_500, 3_000), LD1)


@query("ld_intervals", f"{X.cells_with()} SELECT {shown(LD1)} FROM cells WHERE rid_a = 0 AND rid_b = 0 AND pos_a + 1 BETWEEN 5000 AND 14000 AND pos_b + 1 BETWEEN 5000 AND 14000")
def _(s, d):
    v = X.variants(s, d).filter(V.variant_slices(["c0:5e3-1.4e4"], X.IDS))
    return show(P.pair_cells(v, block=16), LD1)


@query("ld_chunk", f"{X.cells_with()} SELECT {shown(LD1)} FROM cells WHERE va // 32 = 0 AND vb // 32 = 1")
def _(s, d):
    return show(dense(s, d, chunk=(3, 1)), LD1)


@query("ld_cross_contig", f"{X.cells_with()} SELECT {shown(LD1)} FROM cells WHERE rid_a <> rid_b")
def _(s, d):
    return show(dense(s, d, contigs="different"), LD1)


@query("ld_same_contig", f"{X.cells_with()} SELECT {shown(LD1)} FROM cells WHERE rid_a = rid_b")
def _(s, d):
    return show(dense(s, d, contigs="same"), LD1)


@query("ld_mirror", f"{X.ld_with()} SELECT {shown(LD1, ['r2'])} FROM ld")
def _(s, d):
    return show(ld(s, d), LD1, ["r2"])


# -- kernels -------------------------------------------------------------------
@query("kernel_dense", f"{X.cells_with()} SELECT {shown(LD1)} FROM cells")
def _(s, d):
    return show(dense(s, d), LD1)


@query("kernel_masked", f"{X.cells_with(True)} SELECT {shown(LD1)} FROM cells")
def _(s, d):
    return show(dense(s, d, missing=True), LD1)


@query("kernel_bits", f"{X.cells_with()} SELECT CAST(va AS BIGINT) AS va, CAST(vb AS BIGINT) AS vb, {shown(CELLS)} FROM cells WHERE rid_a = rid_b AND pos_b - pos_a <= 4000")
def _(s, d):
    v = X.variants(s, d).select("rid", "pos", "ac", "hap_bits", "n_haps", "variant_id", F.floor(F.col("pos") / 4000).alias("bin"))
    a = v.select("rid", *[F.col(c).alias(f"{c}_a") for c in ("pos", "ac", "hap_bits", "variant_id")], F.explode(F.array("bin", F.col("bin") + 1)).alias("bin"))
    b = v.select("rid", "bin", "n_haps", *[F.col(c).alias(f"{c}_b") for c in ("pos", "ac", "hap_bits", "variant_id")])
    near = a.join(b, ["rid", "bin"]).filter("variant_id_a < variant_id_b AND pos_b - pos_a BETWEEN 0 AND 4000")
    return show(P.bit_cells(near).withColumnsRenamed({"variant_id_a": "va", "variant_id_b": "vb"}), ["va", "vb", *CELLS])


SPARSE_SQL = """WITH rows AS (SELECT DISTINCT l_partkey AS v, l_orderkey AS h FROM lineitem), tot AS (SELECT CAST(count(DISTINCT h) AS DOUBLE) AS n FROM rows),
m AS (SELECT v, count(*) AS ac FROM rows GROUP BY v),
c AS (SELECT a.v AS va, b.v AS vb, count(*) AS aa FROM rows a JOIN rows b ON a.h = b.h AND a.v < b.v GROUP BY a.v, b.v),
f AS (SELECT va, vb, aa, x.ac - aa AS ar, y.ac - aa AS ra, n - x.ac - y.ac + aa AS rr, n FROM c JOIN m x ON va = x.v JOIN m y ON vb = y.v, tot)
SELECT CAST(va AS BIGINT) AS va, CAST(vb AS BIGINT) AS vb, CAST(rr AS BIGINT) AS ref_ref, CAST(ra AS BIGINT) AS ref_alt, CAST(ar AS BIGINT) AS alt_ref, CAST(aa AS BIGINT) AS alt_alt,
round(((rr / n) * (aa / n) - (ra / n) * (ar / n)) * ((rr / n) * (aa / n) - (ra / n) * (ar / n)) / (((rr + ra) / n) * ((ar + aa) / n) * ((rr + ar) / n) * ((ra + aa) / n)), 6) AS r2 FROM f"""


@query("kernel_sparse", SPARSE_SQL)
def _(s, d):
    c = X.carriers(s, d)
    n = c.select("hap_idx").distinct().count()
    out = with_ld_stats(P.sparse_cells(c, n))
    return show(out.withColumnsRenamed({"variant_id_a": "va", "variant_id_b": "vb"}), ["va", "vb", *CELLS], ["r2"])


NINE = [f"g{i}{j}" for i in range(3) for j in range(3)]
GENO_SQL = """geno AS (SELECT variant_id, rid, pos, sample_id, sum(allele) AS g FROM hap GROUP BY variant_id, rid, pos, sample_id HAVING max(allele) < 2),
nine AS (SELECT a.variant_id AS va, b.variant_id AS vb, a.rid AS rid_a, a.pos AS pos_a, b.rid AS rid_b, b.pos AS pos_b, """ + ", ".join(
    f"CAST(sum(CASE WHEN a.g = {i} AND b.g = {j} THEN 1 ELSE 0 END) AS DOUBLE) AS g{i}{j}" for i in range(3) for j in range(3)
) + " FROM geno a JOIN geno b ON a.sample_id = b.sample_id AND a.variant_id < b.variant_id GROUP BY 1, 2, 3, 4, 5, 6)"


@query("kernel_genotypes", f"WITH {X.hap_sql()}, {GENO_SQL} SELECT {shown([*IDS, *NINE])} FROM nine")
def _(s, d):
    return show(dense(s, d, model="unphased"), [*IDS, *NINE])


@query("kernel_genotypes_masked", f"WITH {X.hap_sql(True)}, {GENO_SQL} SELECT {shown([*IDS, *NINE])} FROM nine")
def _(s, d):
    return show(dense(s, d, missing=True, model="unphased"), [*IDS, *NINE])


# -- statistics ----------------------------------------------------------------
for _name, _cols in {"ld_d": ["d"], "ld_r2": ["r2"], "ld_r": ["r", "r_signed"], "ld_dprime": ["dprime"], "chisq_table": ["chisq_fisher"]}.items():

    def _stat(s, d, cols=tuple(_cols)):
        return show(ld(s, d, mirror=False), IDS, list(cols))

    query(_name, f"{X.stats_with()} SELECT {shown(IDS, _cols)} FROM ld1")(_stat)


@query("fisher_exact", f"{X.stats_with()}, {X.FISHER_SQL} SELECT {shown(IDS)}, round(p, 6) AS p FROM ld1 JOIN pv ON ld1.va = pv.va AND ld1.vb = pv.vb")
def _(s, d):
    return show(ld(s, d, exact_p=True, mirror=False), IDS, ["p"])


@query("ld_flags", f"{X.stats_with(True)} SELECT {shown([*IDS, 'flag'])} FROM ld1")
def _(s, d):
    return show(compute_ld(X.variants(s, d, True), model="phased", min_r2=0.0, exact_p=False, mirror=False, block=16), [*IDS, "flag"])


def cubic_with(missing: bool = False) -> str:
    return f"""WITH {X.hap_sql(missing)}, {GENO_SQL},
base AS (SELECT *, g00+g01+g02+g10+g11+g12+g20+g21+g22 AS n FROM nine),
fr AS (SELECT *, (2*(g00+g01+g02)+g10+g11+g12)/(2*n) AS p, (2*(g00+g10+g20)+g01+g11+g21)/(2*n) AS q, 2*g00+g01+g10 AS k FROM base),
poly AS (SELECT *, 4*n AS a, 2*n*(1-2*p-2*q)-2*k-g11 AS b, -k*(1-2*p-2*q)-g11*(1-p-q)+2*n*p*q AS c, -k*p*q AS e FROM fr),
tip AS (SELECT *, -b/(3*a) AS x, (b*b-3*a*c)/(9*a*a) AS w FROM poly),
tip2 AS (SELECT *, a*x*x*x+b*x*x+c*x+e AS y, 4*a*a*w*w*w AS h2 FROM tip),
tip3 AS (SELECT *, sqrt(greatest(w, 0)) AS dl, sqrt(greatest(y*y-h2, 0)) AS sd FROM tip2),
roots AS (
  SELECT *, k/(2*n) AS f FROM tip3 WHERE g11 = 0
  UNION ALL SELECT *, x+2*dl*cos(acos(greatest(-1.0, least(1.0, -y/(2*a*dl*dl*dl))))/3) AS f FROM tip3 WHERE g11 > 0 AND y*y < h2
  UNION ALL SELECT *, x+2*dl*cos(acos(greatest(-1.0, least(1.0, -y/(2*a*dl*dl*dl))))/3+2*pi()/3) AS f FROM tip3 WHERE g11 > 0 AND y*y < h2
  UNION ALL SELECT *, x+2*dl*cos(acos(greatest(-1.0, least(1.0, -y/(2*a*dl*dl*dl))))/3+4*pi()/3) AS f FROM tip3 WHERE g11 > 0 AND y*y < h2
  UNION ALL SELECT *, x+sign((sd-y)/(2*a))*pow(abs((sd-y)/(2*a)), 1.0/3)+sign((-y-sd)/(2*a))*pow(abs((-y-sd)/(2*a)), 1.0/3) AS f FROM tip3 WHERE g11 > 0 AND y*y > h2),
valid AS (SELECT *, p-f AS f01, q-f AS f10, 1-p-q+f AS f11 FROM roots WHERE f >= k/(2*n)-1e-5 AND f <= (k+g11)/(2*n)+1e-5),
ex AS (SELECT *, n*f*f AS e00, n*2*f*f01 AS e01, n*f01*f01 AS e02, n*2*f*f10 AS e10, n*(2*f01*f10+2*f*f11) AS e11, n*2*f01*f11 AS e12, n*f10*f10 AS e20, n*2*f10*f11 AS e21, n*f11*f11 AS e22 FROM valid),
chi AS (SELECT *, {" + ".join(f"CASE WHEN e{i}{j} > 0 THEN (g{i}{j}-e{i}{j})*(g{i}{j}-e{i}{j})/e{i}{j} ELSE 0 END" for i in range(3) for j in range(3))} AS chisq_model FROM ex),
best AS (SELECT *, row_number() OVER (PARTITION BY va, vb ORDER BY chisq_model, f) AS rn FROM chi)"""


CUBIC_SQL = f"{cubic_with()} SELECT {shown(IDS)}, round(f, 6) AS f11, round(chisq_model, 4) AS chisq_model, round(f*2*n, 4) AS ref_ref, round(f01*2*n, 4) AS ref_alt, round(f10*2*n, 4) AS alt_ref, round(f11*2*n, 4) AS alt_alt FROM best WHERE rn = 1"


def unphased_ld_with(missing: bool, test: str) -> str:
    """``ld1`` of the pairs of which ``test`` holds by the cubic, and of the others by their phased cells; ``cm`` is the model's chi-squared."""
    both = X.CELLS_SQL.replace("cells AS (SELECT c.*", "phased AS (SELECT c.*")
    ids = "va, vb, rid_a, pos_a, rid_b, pos_b"
    return f"""{cubic_with(missing)}, {both},
cells AS (SELECT {ids}, ref_ref, ref_alt, alt_ref, alt_alt, ac_a, ac_b, miss_a, miss_b, 0.0 AS cm FROM phased WHERE NOT ({test})
  UNION ALL SELECT {", ".join(f"b.{c}" for c in ids.split(", "))}, f*2*b.n, f01*2*b.n, f10*2*b.n, f11*2*b.n, ac_a, ac_b, miss_a, miss_b, b.chisq_model FROM best b JOIN phased c ON b.va = c.va AND b.vb = c.vb WHERE rn = 1 AND {test}),
{X.STATS_SQL}"""


@query("unphased_cubic", CUBIC_SQL)
def _(s, d):
    out = with_unphased_haplotypes(dense(s, d, model="unphased"))
    return out.select(*[F.col(c).cast("long").alias(c) for c in IDS], F.round("f11", 6).alias("f11"), *[F.round(c, 4).alias(c) for c in ("chisq_model", *CELLS)])


@query("ld_auto", f"{unphased_ld_with(True, '(miss_a > 0 OR miss_b > 0)')} SELECT {shown(IDS)}, round(r2, 5) AS r2, round(d, 5) AS d, round(cm, 3) AS chisq_model FROM ld1 WHERE r2 >= 0.1")
def _(s, d):
    """Auto model on the fixture with missing alleles: the unphased path where a side has some."""
    out = compute_ld(X.variants(s, d, True), model="auto", min_r2=0.1, mirror=False, exact_p=False, block=16)
    return out.select(*[F.col(c).cast("long").alias(c) for c in IDS], F.round("r2", 5).alias("r2"), F.round("d", 5).alias("d"), F.round("chisq_model", 3).alias("chisq_model"))


# -- scans and sinks -------------------------------------------------------------
@query("twk_scan", f"WITH {X.hap_sql()} SELECT CAST(variant_id AS BIGINT) AS variant_id, CAST(rid AS BIGINT) AS rid, CAST(pos AS BIGINT) AS pos, CAST(sum(allele) AS BIGINT) AS ac FROM hap GROUP BY variant_id, rid, pos")
def _(s, d):
    return show(X.variants(s, d), ["variant_id", "rid", "pos", "ac"])


@query("twk_index_scan", f"WITH {X.hap_sql()} SELECT CAST(variant_id AS BIGINT) AS variant_id, CAST(rid AS BIGINT) AS rid, CAST(pos AS BIGINT) AS pos, CAST(sum(allele) AS BIGINT) AS ac FROM hap WHERE rid = 2 AND pos BETWEEN 33000 AND 41000 GROUP BY variant_id, rid, pos")
def _(s, d):
    t = _stored(s, X.variants(s, d), store.write_variants)
    return show(t.filter("rid = 2 AND pos BETWEEN 33000 AND 41000"), ["variant_id", "rid", "pos", "ac"])


@query("ld_scan", f"{X.ld_with()} SELECT {shown(['flag', *LD1], STAT)} FROM ld")
def _(s, d):
    return show(_stored(s, ld(s, d), lambda df, p: store.write_ld(df, p, by_position=False)), ["flag", *LD1], STAT)


@query("ld_index_scan", f"{X.ld_with()} SELECT {shown(LD1, ['r2'])} FROM ld WHERE rid_a = 1 AND pos_a BETWEEN 18000 AND 21000")
def _(s, d):
    return show(pair_table(s, d).filter("rid_a = 1 AND pos_a BETWEEN 18000 AND 21000"), LD1, ["r2"])


@query("ld_text", f"{X.ld_with()} SELECT 'c' || CAST(rid_a AS VARCHAR) AS contig_a, CAST(pos_a + 1 AS BIGINT) AS pos_a, 'c' || CAST(rid_b AS VARCHAR) AS contig_b, CAST(pos_b + 1 AS BIGINT) AS pos_b, {shown(['flag', *CELLS], STAT)} FROM ld")
def _(s, d):
    t = store.ld_text(pair_table(s, d), X.contigs(s))
    return t.select("contig_a", F.col("pos_a").cast("long").alias("pos_a"), "contig_b", F.col("pos_b").cast("long").alias("pos_b"), *[F.col(c).cast("long").alias(c) for c in ("flag", *CELLS)], *[F.round(c, 6).alias(c) for c in STAT])


_J = " || ',' || ".join([f"CAST(CAST({c} AS BIGINT) AS VARCHAR)" for c in ("flag", "rid_a", "pos_a + 1", "rid_b", "pos_b + 1")] + [f"CAST(CAST(round({c}, 6) AS DECIMAL(30, 6)) AS VARCHAR)" for c in (*CELLS, "d", "dprime", "r", "r2", "p", "chisq_fisher", "chisq_model")])


@query("ld_json", f"{X.ld_with(True)} SELECT '[' || {_J} || ']' AS json FROM ld")
def _(s, d):
    return store.ld_json(pair_table(s, d, True))


def _samples(s: SparkSession, names: list[str]) -> DataFrame:
    return s.createDataFrame(list(enumerate(names)), "sample_id int, sample string")


@query("twk_open", "WITH c AS (SELECT unnest(range(4)) AS i) SELECT CAST(i AS BIGINT) AS contig_id, 'c' || CAST(i AS VARCHAR) AS contig, CAST(62000 AS BIGINT) AS n_bases, CAST(3 AS BIGINT) AS n_samples FROM c")
def _(s, d):
    path = shared_folder(s, "twk")
    store.write_variants(X.variants(s, d), path)
    store.write_sidecar(s, path, X.contigs(s), _samples(s, ["s0", "s1", "s2"]), "import -i fixture")
    _rows, header = store.open_table(s, path)
    rows = [(c["contig_id"], c["contig"], c["n_bases"], len(header["samples"])) for c in header["contigs"]]
    return s.createDataFrame(rows, "contig_id long, contig string, n_bases long, n_samples long")


@query("provenance", "SELECT * FROM (VALUES (0, 'calc -p', ''), (1, 'view -r 0.05', ''), (2, 'sort', 'rid_a,rid_b,pos_a,pos_b')) t(step, command, sorted_by)")
def _(s, d):
    """Each command adds its line to the header that it read, and says how its rows are sorted."""
    first, second, third = (shared_folder(s, "ld") for _ in range(3))
    store.write_ld(pair_table(s, d), first, by_position=False)
    store.write_sidecar(s, first, X.contigs(s), _samples(s, ["s0"]), "calc -p")
    table, header = store.open_table(s, first)
    store.derive(V.view(table, {"r2": (0.05, None)}), header, second, "view -r 0.05")
    store.derive(*store.open_table(s, second), third, "sort", by_position=True)
    rows = [(k, (h := store.read_sidecar(s, p))["commands"][-1], ",".join(h["sorted_by"])) for k, p in enumerate((first, second, third))]
    return s.createDataFrame(rows, "step int, command string, sorted_by string")


@query("raster_store", f"{X.ld_with()} SELECT CAST((rid_a * 62000 + pos_a) // 6200 AS BIGINT) AS x_bin, CAST((rid_b * 62000 + pos_b) // 6200 AS BIGINT) AS y_bin, CAST(count(*) AS DOUBLE) AS value, CAST(40 AS BIGINT) AS bins, 'count' AS reduce FROM ld GROUP BY 1, 2")
def _(s, d):
    path = shared_folder(s, "twa")
    store.write_raster(A.raster(pair_table(s, d), X.contigs(s), 40, 40, "r2", "count"), path, bins=40, value="r2", reduce="count")
    cells, settings = store.open_raster(s, path)
    return cells.select(F.col("x_bin").cast("long").alias("x_bin"), F.col("y_bin").cast("long").alias("y_bin"), "value", F.lit(settings["bins"]).cast("long").alias("bins"), F.lit(settings["reduce"]).alias("reduce"))


@query("header_only", "WITH c AS (SELECT unnest(range(4)) AS i) SELECT '##contig=<ID=c' || CAST(i AS VARCHAR) || ',length=62000>' AS line FROM c")
def _(s, d):
    return store.header_rows(X.contigs(s))


# -- import ----------------------------------------------------------------------
def _records(s: SparkSession, d: str) -> DataFrame:
    lines = X.vcf_lines(s, d)
    contigs, _names = vcf.vcf_header(lines)
    return vcf.vcf_records(lines, contigs)


@query("vcf_header", "WITH c AS (SELECT unnest(range(4)) AS i) SELECT CAST(i AS BIGINT) AS contig_id, 'c' || CAST(i AS VARCHAR) AS contig, CAST(62000 AS BIGINT) AS n_bases FROM c")
def _(s, d):
    c, _names = vcf.vcf_header(X.vcf_lines(s, d))
    return c.select(F.col("contig_id").cast("long").alias("contig_id"), "contig", "n_bases")


@query("vcf_samples", "WITH m AS (SELECT max(vec_id) // 2 AS top FROM embeddings), i AS (SELECT unnest(range((SELECT top FROM m) + 1)) AS k) SELECT CAST(k AS BIGINT) AS sample_id, 's' || CAST(k AS VARCHAR) AS sample FROM i")
def _(s, d):
    _c, names = vcf.vcf_header(X.vcf_lines(s, d))
    return names.select(F.col("sample_id").cast("long").alias("sample_id"), "sample")


SITE_SQL = f"""WITH {X.hap_sql(True)},
gt AS (SELECT variant_id, rid, pos, sample_id, max(CASE WHEN hap_idx % 2 = 0 THEN own END) AS a, max(CASE WHEN hap_idx % 2 = 1 THEN own END) AS b
 FROM (SELECT *, CASE WHEN variant_id % 23 = 22 THEN 0 ELSE allele END AS own FROM hap) h GROUP BY variant_id, rid, pos, sample_id),
site AS (SELECT variant_id, rid, pos, count(*) AS n_samples, sum(CASE WHEN a < 2 AND b < 2 THEN 1 ELSE 0 END) AS n_called,
 sum(CASE WHEN a = 0 AND b = 0 THEN 1 ELSE 0 END) AS n_hom_ref, sum(CASE WHEN a = 0 AND b = 1 THEN 1 ELSE 0 END) AS n_01, sum(CASE WHEN a = 1 AND b = 0 THEN 1 ELSE 0 END) AS n_10,
 sum(CASE WHEN a + b = 1 AND a < 2 AND b < 2 THEN 1 ELSE 0 END) AS n_het, sum(CASE WHEN a = 1 AND b = 1 THEN 1 ELSE 0 END) AS n_hom_alt,
 sum(CASE WHEN a = 1 THEN 1 ELSE 0 END + CASE WHEN b = 1 THEN 1 ELSE 0 END) AS ac, sum(CASE WHEN a = 2 THEN 1 ELSE 0 END + CASE WHEN b = 2 THEN 1 ELSE 0 END) AS n_missing FROM gt GROUP BY variant_id, rid, pos),
form AS (SELECT *, CASE WHEN variant_id % 19 = 18 THEN 'mixed_ploidy' WHEN variant_id % 13 = 12 THEN 'multiallelic' WHEN variant_id % 17 = 16 THEN 'not_snv' END AS bad, greatest(n_hom_ref, n_01, n_10, n_hom_alt) = n_called AS flat FROM site),
judged AS (SELECT *, CASE WHEN bad IS NOT NULL THEN bad WHEN n_called < 0.9 * n_samples THEN 'missing' WHEN flat THEN 'invariant' ELSE 'kept' END AS reason FROM form)"""
TWICE = "CASE WHEN variant_id % 19 = 18 THEN 'mixed_ploidy' ELSE 'multiallelic' END"


@query("import_report", f"{SITE_SQL}, every AS (SELECT reason FROM judged UNION ALL SELECT CASE WHEN reason = 'kept' THEN 'duplicate' ELSE reason END FROM judged WHERE variant_id % 11 = 10 UNION ALL SELECT {TWICE} FROM judged WHERE variant_id % 7 = 6) SELECT reason, count(*) AS n FROM every GROUP BY reason")
def _(s, d):
    return vcf.import_report(vcf.judged(_records(s, d)))


IMPORT_SQL = f"{SITE_SQL} SELECT CAST(rid AS BIGINT) AS rid, CAST(pos AS BIGINT) AS pos, CAST(ac AS BIGINT) AS ac, CAST(n_missing AS BIGINT) AS n_missing, CAST(n_het AS BIGINT) AS n_het, CAST(n_hom_alt AS BIGINT) AS n_hom_alt, true AS phased FROM judged WHERE reason = 'kept'"
IMPORTED = ["rid", "pos", "ac", "n_missing", "n_het", "n_hom_alt"]


@query("import_variants", IMPORT_SQL)
def _(s, d):
    return vcf.import_variants(_records(s, d)).select(*[F.col(c).cast("long").alias(c) for c in IMPORTED], "phased")


@query("vcf_scan", IMPORT_SQL)
def _(s, d):
    """The import of a VCF file that was written as text."""
    path = shared_folder(s, "vcf")
    X.vcf_lines(s, d).repartition(1).sortWithinPartitions("line").select("value").write.text(path)
    lines = vcf.read_lines(s, path)
    contigs, _names = vcf.vcf_header(lines)
    return vcf.import_variants(vcf.vcf_records(lines, contigs)).select(*[F.col(c).cast("long").alias(c) for c in IMPORTED], "phased")


@query("filter_min_samples", f"{SITE_SQL} SELECT CAST(rid AS BIGINT) AS rid, CAST(pos AS BIGINT) AS pos, CAST(n_called AS BIGINT) AS n_called FROM judged WHERE bad IS NULL AND NOT flat AND n_called >= 240")
def _(s, d):
    return show(vcf.judged(_records(s, d), min_call_rate=0.0, min_samples=240).filter("reason IS NULL"), ["rid", "pos", "n_called"])


@query("keep_invariant", f"{SITE_SQL} SELECT CAST(rid AS BIGINT) AS rid, CAST(pos AS BIGINT) AS pos, CAST(n_hom_ref AS BIGINT) AS n_hom_ref FROM judged WHERE reason IN ('kept', 'invariant')")
def _(s, d):
    return show(vcf.judged(_records(s, d), drop_invariant=False).filter("reason IS NULL"), ["rid", "pos", "n_hom_ref"])


HWE_WITH = f"""{SITE_SQL}, k AS (SELECT rid, pos, CAST(n_called AS BIGINT) AS n_called, CAST(n_het AS BIGINT) AS n_het, CAST(2 * least(n_hom_ref, n_hom_alt) + n_het AS BIGINT) AS rare FROM judged WHERE reason = 'kept'),
t AS (SELECT rid, pos, n_called AS n, n_het, rare, unnest(range(rare % 2, rare + 1, 2)) AS i FROM k),
l AS (SELECT rid, pos, n_het, i, i * ln(2.0) - lgamma(i + 1.0) - lgamma((rare - i) / 2 + 1.0) - lgamma(n - (rare + i) / 2 + 1.0) AS lp FROM t),
m AS (SELECT rid, pos, max(lp) AS top, max(CASE WHEN i = n_het THEN lp END) AS seen FROM l GROUP BY rid, pos),
hw AS (SELECT CAST(l.rid AS BIGINT) AS rid, CAST(l.pos AS BIGINT) AS pos, round(least(1.0, sum(CASE WHEN exp(lp - top) <= exp(seen - top) * 1.000000001 THEN exp(lp - top) ELSE 0 END) / sum(exp(lp - top))), 6) AS hwe_p
FROM l JOIN m ON l.rid = m.rid AND l.pos = m.pos GROUP BY l.rid, l.pos)"""


@query("hwe_exact", f"{HWE_WITH} SELECT * FROM hw")
def _(s, d):
    return show(vcf.judged(_records(s, d)).filter("reason IS NULL"), ["rid", "pos"], ["hwe_p"])


@query("filter_hwe", f"{HWE_WITH} SELECT * FROM hw WHERE hwe_p >= 0.3")
def _(s, d):
    return show(vcf.judged(_records(s, d), min_hwe=0.3).filter("reason IS NULL"), ["rid", "pos"], ["hwe_p"])


_COUNTS = "CAST(rid AS BIGINT) AS rid, CAST(pos AS BIGINT) AS pos, CAST(n_called AS BIGINT) AS n_called, CAST(n_hom_ref AS BIGINT) AS n_hom_ref, CAST(n_het AS BIGINT) AS n_het, CAST(n_hom_alt AS BIGINT) AS n_hom_alt FROM judged WHERE variant_id % 19 <> 18"


@query("gt_summary", f"{SITE_SQL} SELECT {_COUNTS} UNION ALL SELECT {_COUNTS} AND variant_id % 11 = 10 UNION ALL SELECT {_COUNTS} AND variant_id % 7 = 6")
def _(s, d):
    """Every record, those of repeated sites each (the twin lists them once more); haploid records have no such counts."""
    return show(vcf.genotype_summary(_records(s, d)).filter("diploid"), ["rid", "pos", "n_called", "n_hom_ref", "n_het", "n_hom_alt"])


@query("flip_major_minor", f"{SITE_SQL} SELECT CAST(rid AS BIGINT) AS rid, CAST(pos AS BIGINT) AS pos, CAST(CASE WHEN 2 * ac > 2 * n_samples - n_missing THEN 2 * n_samples - n_missing - ac ELSE ac END AS BIGINT) AS ac, 2 * ac > 2 * n_samples - n_missing AS flipped FROM judged WHERE reason = 'kept'")
def _(s, d):
    out = vcf.import_variants(_records(s, d), flip=True)
    return out.select(*[F.col(c).cast("long").alias(c) for c in ("rid", "pos", "ac")], "flipped")


@query("dense_ids", f"WITH {X.hap_sql()} SELECT DISTINCT CAST(variant_id AS BIGINT) AS variant_id, CAST(pos AS BIGINT) AS pos FROM hap")
def _(s, d):
    return show(X.numbered_variants(s, d), ["variant_id", "pos"])


# -- views -----------------------------------------------------------------------
_RANGES = {"r2": (0.01, 0.2), "r": (0.05, 0.3), "d": (-0.01, 0.02), "dprime": (0.1, 0.5), "p": (0.0, 0.01), "ref_ref": (100, 130), "ref_alt": (100, 130), "alt_ref": (110, None), "alt_alt": (None, 125), "mhc": (370, 380), "chisq_table": (3.84, 50)}
for _name, (_lo, _hi) in _RANGES.items():
    _col = "(ref_ref + ref_alt + alt_ref + alt_alt - greatest(ref_ref, ref_alt, alt_ref, alt_alt))" if _name == "mhc" else V.RANGES[_name]
    _test = " AND ".join(([f"{_col} >= {_lo}"] if _lo is not None else []) + ([f"{_col} <= {_hi}"] if _hi is not None else []))

    def _filter(s, d, name=_name, lo=_lo, hi=_hi):
        return show(V.view(pair_table(s, d, name == "p"), {name: (lo, hi)}), LD1, ["r2"])

    query(f"filter_{_name}", f"{X.ld_with(_name == 'p')} SELECT {shown(LD1, ['r2'])} FROM ld WHERE {_test}")(_filter)


@query("filter_chisq_model", f"{unphased_ld_with(False, 'true')} SELECT {shown(IDS)}, round(cm, 3) AS chisq_model FROM ld1 WHERE cm >= 0.5 AND cm <= 3")
def _(s, d):
    t = compute_ld(X.variants(s, d), model="unphased", min_r2=0.0, mirror=False, exact_p=False, block=16)
    return V.view(t, {"chisq_model": (0.5, 3)}).select(*[F.col(c).cast("long").alias(c) for c in IDS], F.round("chisq_model", 3).alias("chisq_model"))


_VIEWS = {
    "filter_flags": ("(flag & 2) <> 0 AND (flag & 8) = 0", {"include": 2, "exclude": 8}),
    "upper_triangle": ("rid_a = rid_b AND pos_a < pos_b", {"triangle": "upper"}),
    "lower_triangle": ("rid_a = rid_b AND pos_b < pos_a", {"triangle": "lower"}),
    "slice_contig": ("rid_a = 1", {"intervals": ["c1"]}),
    "slice_position": ("rid_a = 0 AND pos_a = 5000", {"intervals": ["c0:5001"]}),
    "slice_range": ("rid_a = 2 AND pos_a + 1 BETWEEN 35000 AND 40000", {"intervals": ["c2:3.5e4-4e4"]}),
    "slice_linked": ("rid_a = 0 AND pos_a + 1 BETWEEN 1 AND 4000 AND rid_b = 1", {"intervals": ["c0:1-4000,c1"]}),
    "slice_multi": ("(rid_a = 0 AND pos_a + 1 BETWEEN 1 AND 9000) OR (rid_a = 0 AND pos_a + 1 BETWEEN 2000 AND 3000) OR rid_a = 3", {"intervals": ["c0:1-9000", "c0:2000-3000", "c3"]}),
}
for _name, (_test, _kw) in _VIEWS.items():

    def _view(s, d, kw=_kw):
        return show(V.view(pair_table(s, d), ids=X.IDS, **kw), LD1, ["r2"])

    query(_name, f"{X.ld_with()} SELECT {shown(LD1, ['r2'])} FROM ld WHERE {_test}")(_view)


@query("slice_table", f"{X.ld_with()} SELECT {shown(LD1)} FROM ld WHERE (rid_a = 0 AND pos_a + 1 BETWEEN 1000 AND 5000) OR (rid_a = 2 AND pos_a + 1 BETWEEN 36000 AND 39000)")
def _(s, d):
    t = s.createDataFrame([(0, 1000, 5000), (2, 36_000, 39_000)], "rid int, start int, stop int")
    return show(V.slice_by_table(pair_table(s, d), t, 2000), LD1)


@query("view_convert", f"{X.ld_with()} SELECT {shown(LD1, ['r2'])} FROM ld WHERE r2 >= 0.05")
def _(s, d):
    t = _stored(s, V.view(pair_table(s, d), {"r2": (0.05, None)}), store.write_ld)
    return show(t, LD1, ["r2"])


# -- aggregations ------------------------------------------------------------------
@query("agg_landscape", f"{X.ld_with()} SELECT rid, min(pos) AS min_pos, max(pos) AS max_pos FROM (SELECT CAST(rid_a AS BIGINT) AS rid, CAST(pos_a AS BIGINT) AS pos FROM ld UNION ALL SELECT CAST(rid_b AS BIGINT), CAST(pos_b AS BIGINT) FROM ld) x GROUP BY rid")
def _(s, d):
    return show(A.landscape(pair_table(s, d)), ["rid", "min_pos", "max_pos"])


@query("agg_offsets", "WITH c AS (SELECT unnest(range(4)) AS i) SELECT CAST(i AS BIGINT) AS rid, CAST(i * 62000 AS BIGINT) AS \"offset\", CAST(0 AS BIGINT) AS \"first\", CAST(62000 AS BIGINT) AS span FROM c")
def _(s, d):
    return show(A.offsets(pair_table(s, d), X.contigs(s)), ["rid", "offset", "first", "span"])


_XY = "CAST((rid_a * 62000 + pos_a) // 6200 AS BIGINT) AS x_bin, CAST((rid_b * 62000 + pos_b) // 6200 AS BIGINT) AS y_bin"
_TOT = "(ref_ref + ref_alt + alt_ref + alt_alt)"
_VALUES = {"r2": "r2", "r": "r", "d": "d", "dprime": "dprime", "hets": f"(ref_alt + alt_ref) / {_TOT}", "alts": f"alt_alt / {_TOT}"}
for _name, _expr in _VALUES.items():

    def _raster(s, d, name=_name):
        return show(A.raster(pair_table(s, d), X.contigs(s), 40, 40, name), ["x_bin", "y_bin", "n"], ["value"])

    query(f"agg_raster_{_name}", f"{X.ld_with()} SELECT {_XY}, round(avg({_expr}), 6) AS value, count(*) AS n FROM ld GROUP BY 1, 2")(_raster)
_REDUCE = {"mean": "CASE WHEN count(*) >= 3 THEN avg(r2) ELSE 0 END", "count": "CASE WHEN count(*) >= 3 THEN CAST(count(*) AS DOUBLE) ELSE 0 END", "sd": "CASE WHEN count(*) >= 3 THEN stddev_pop(r2) ELSE 0 END", "min": "min(r2)", "max": "max(r2)", "total": "CASE WHEN sum(r2) >= 3 THEN sum(r2) ELSE 0 END", "total2": "sum(r2 * r2)"}
for _name, _expr in _REDUCE.items():

    def _reduce(s, d, name=_name):
        return show(A.raster(pair_table(s, d), X.contigs(s), 40, 40, "r2", name, 3), ["x_bin", "y_bin"], ["value"])

    query(f"reduce_{_name}", f"{X.ld_with()} SELECT {_XY}, round({_expr}, 6) AS value FROM ld GROUP BY 1, 2")(_reduce)


@query("matrix_text", f"{X.ld_with()}, c AS (SELECT {_XY}, CAST(count(*) AS DOUBLE) AS value FROM ld GROUP BY 1, 2), g AS (SELECT x.i AS x, y.i AS y FROM (SELECT unnest(range(40)) AS i) x CROSS JOIN (SELECT unnest(range(40)) AS i) y) SELECT CAST(x AS BIGINT) AS x_bin, string_agg(CAST(coalesce(value, 0.0) AS VARCHAR), chr(9) ORDER BY y) AS line FROM g LEFT JOIN c ON c.x_bin = x AND c.y_bin = y GROUP BY x")
def _(s, d):
    t = A.matrix_text(A.raster(pair_table(s, d), X.contigs(s), 40, 40, "r2", "count"), 40)
    return t.select(F.col("x_bin").cast("long").alias("x_bin"), "line")


@query("stats_r2_hist", f"{X.ld_with()} SELECT CAST(floor(r2 * 100 + 1e-9) AS BIGINT) AS bin, round(sum(r2), 6) AS total, count(*) AS n FROM ld GROUP BY 1")
def _(s, d):
    return show(A.r2_histogram(pair_table(s, d)), ["bin", "n"], ["total"])


@query("stats_flag_counts", f"{X.ld_with()}, bits AS (SELECT unnest(range(16)) AS b) SELECT CAST(b AS BIGINT) AS bit, count(*) AS n FROM ld JOIN bits ON (CAST(flag AS BIGINT) >> b) % 2 = 1 GROUP BY b")
def _(s, d):
    return show(A.flag_counts(pair_table(s, d)), ["bit", "n"])


@query("stats_cell_hist", f"{X.ld_with()} " + " UNION ALL ".join(f"SELECT '{c}' AS cell, CAST({c} AS BIGINT) AS value, count(*) AS n FROM ld GROUP BY 2" for c in CELLS))
def _(s, d):
    return A.cell_histogram(pair_table(s, d)).select("cell", F.col("value").cast("long").alias("value"), "n")


@query("stats_contig_matrix", f"{X.ld_with()} SELECT CAST(rid_a AS BIGINT) AS rid_a, CAST(rid_b AS BIGINT) AS rid_b, count(*) AS n FROM ld GROUP BY 1, 2")
def _(s, d):
    return show(A.contig_matrix(pair_table(s, d)), ["rid_a", "rid_b", "n"])


@query("decay_binned", f"{X.ld_with()}, k AS (SELECT unnest(range(10)) AS b), f AS (SELECT least((pos_b - pos_a) // 1000, 9) AS b, avg(r2) AS m, count(*) AS n FROM ld WHERE rid_a = rid_b AND pos_a < pos_b GROUP BY 1) SELECT CAST(k.b * 1000 AS BIGINT) AS from_bp, CAST((k.b + 1) * 1000 AS BIGINT) AS to_bp, round(coalesce(m, 0), 6) AS mean_r2, CAST(coalesce(n, 0) AS BIGINT) AS frequency FROM k LEFT JOIN f ON k.b = f.b")
def _(s, d):
    return show(A.decay(pair_table(s, d), 10_000, 10), ["from_bp", "to_bp", "frequency"], ["mean_r2"])


@query("decay_positional", f"{X.ld_with()} SELECT CAST(rid_a AS BIGINT) AS rid_a, CAST(pos_a AS BIGINT) AS pos_a, count(*) AS n, round(avg(pos_b) - pos_a, 6) AS mean_distance FROM ld WHERE rid_a = rid_b AND pos_a < pos_b GROUP BY rid_a, pos_a")
def _(s, d):
    return show(A.decay_positional(pair_table(s, d)), ["rid_a", "pos_a", "n"], ["mean_distance"])


@query("relationship", f"WITH {X.hap_sql()}, g AS (SELECT variant_id, sample_id, sum(allele) AS x FROM hap GROUP BY variant_id, sample_id) SELECT CAST(a.sample_id AS BIGINT) AS s1, CAST(b.sample_id AS BIGINT) AS s2, round(CASE WHEN a.sample_id = b.sample_id THEN 1.0 ELSE sum(CASE WHEN a.x = b.x AND a.x <> 1 THEN 2.0 WHEN abs(a.x - b.x) = 2 THEN 0.0 ELSE 1.0 END) / (2.0 * count(*)) END, 6) AS ibs FROM g a JOIN g b ON a.variant_id = b.variant_id GROUP BY a.sample_id, b.sample_id")
def _(s, d):
    return show(A.relationship(X.variants(s, d)), ["s1", "s2"], ["ibs"])


# -- sort, concat, reshape -----------------------------------------------------------
@query("ld_sort", f"{X.ld_with()} SELECT {shown(LD1, ['r2'])} FROM ld ORDER BY rid_a, rid_b, pos_a, pos_b")
def _(s, d):
    return show(R.ld_sort(pair_table(s, d)), LD1, ["r2"])


@query("ld_concat", f"{X.ld_with()} SELECT {shown(LD1, ['r2'])} FROM ld")
def _(s, d):
    """Two stored tables with their headers, over the same samples."""
    paths = []
    for test in ("rid_a = 0", "rid_a > 0"):
        paths.append(shared_folder(s, "part"))
        store.write_ld(pair_table(s, d).filter(test), paths[-1])
        store.write_sidecar(s, paths[-1], X.contigs(s), _samples(s, ["s0", "s1"]), f"calc {test}")
    return show(R.concat_files(s, paths), LD1, ["r2"])


def _haps(s: SparkSession, d: str) -> DataFrame:
    return X.hap_long(s, d, True).withColumn("ref", F.lit("A")).withColumn("alt", F.lit("C"))


@query("haplotype_fasta", f"WITH {X.hap_sql(True)} SELECT '>' || CAST(hap_idx // 2 AS VARCHAR) || '_' || CAST(hap_idx % 2 AS VARCHAR) AS name, string_agg(CASE WHEN allele = 0 THEN 'A' WHEN allele = 1 THEN 'C' ELSE 'N' END, '' ORDER BY variant_id) AS sequence FROM hap GROUP BY hap_idx")
def _(s, d):
    return R.haplotype_fasta(_haps(s, d))


_PLACES = [X.STEP * k for k in range(X.DIMS)]


@query("haplotype_matrix", f"WITH {X.hap_sql(True)} SELECT CAST(hap_idx AS BIGINT) AS hap_idx, " + ", ".join(f"CAST(max(CASE WHEN pos = {p} THEN allele END) AS BIGINT) AS p{p + 1}" for p in _PLACES) + " FROM hap GROUP BY hap_idx")
def _(s, d):
    return R.haplotype_matrix(_haps(s, d), _PLACES).select(*[F.col(c).cast("long").alias(c) for c in ("hap_idx", *(f"p{p + 1}" for p in _PLACES))])


# -- extensions ------------------------------------------------------------------------
PRUNE_SQL = f"""{X.stats_with().replace("WITH ", "WITH RECURSIVE ", 1)},
links AS (SELECT vb AS v, list(va) AS earlier FROM ld1 WHERE r2 >= 0.1 AND rid_a = rid_b GROUP BY vb),
walk AS (SELECT 0 AS v, [0] AS kept UNION ALL
  SELECT w.v + 1, CASE WHEN list_has_any(w.kept, coalesce((SELECT earlier FROM links WHERE links.v = w.v + 1), [])) THEN w.kept ELSE list_append(w.kept, w.v + 1) END FROM walk w WHERE w.v < {X.DIMS - 1})
SELECT CAST(unnest(kept) AS BIGINT) AS variant_id FROM walk WHERE v = {X.DIMS - 1}"""


@query("ld_prune", PRUNE_SQL)
def _(s, d):
    """Greedy pruning at r2 >= 0.1 within contigs."""
    pairs = P.pair_cells(X.variants(s, d), block=16, contigs="same")
    return E.ld_prune(X.variants(s, d), with_ld_stats(pairs), 0.1)


@query("gwas_join", f"{X.ld_with()}, g AS (SELECT 1000 * (p_partkey % 62) AS pos, max(p_size) / 100.0 AS p FROM part GROUP BY 1) SELECT {shown(['pos_a', 'pos_b'], ['r2'])}, round(-log10(g.p), 6) AS minus_log10_p FROM ld JOIN g ON ld.pos_b = g.pos WHERE pos_a = 20000")
def _(s, d):
    part = s.read.parquet(f"{d}/part.parquet")
    g = part.groupBy((1000 * (F.col("p_partkey") % 62)).cast("int").alias("pos")).agg((F.max("p_size") / 100.0).alias("p")).withColumn("rid", F.floor(F.col("pos") / 16_000).cast("int"))
    out = E.gwas_join(pair_table(s, d).filter("pos_a = 20000"), g)
    return show(out, ["pos_a", "pos_b"], ["r2", "minus_log10_p"])


@query("numeric_summary", f"{X.ld_with()} " + " UNION ALL ".join(f"SELECT '{c}' AS name, round(min({c}), 6) AS least, round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS median, round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.75), 6) AS q3, round(max({c}), 6) AS largest FROM ld" for c in ("r2", "d", "dprime")))
def _(s, d):
    t = E.numeric_summary(pair_table(s, d), ["r2", "d", "dprime"], exact=True)
    return t.select("name", *[F.round(c, 6).alias(c) for c in ("least", "q1", "median", "mean", "q3", "largest")])


@query("raster_quantiles", f"{X.ld_with()}, c AS (SELECT {_XY}, CAST(count(*) AS DOUBLE) AS value FROM ld GROUP BY 1, 2) SELECT x_bin, y_bin, value, round(percent_rank() OVER (ORDER BY value), 6) AS \"rank\" FROM c")
def _(s, d):
    t = E.quantile_raster(A.raster(pair_table(s, d), X.contigs(s), 40, 40, "r2", "count"))
    return show(t, ["x_bin", "y_bin"], ["value", "rank"])


@query("r2_bound", f"{X.cells_with()} SELECT {shown(IDS)}, round(greatest(pow(least(a * (1 - b), (1 - a) * b), 2), pow(least(a * b, (1 - a) * (1 - b)), 2)) / (a * (1 - a) * b * (1 - b)), 6) AS bound FROM (SELECT *, ac_a / (ref_ref + ref_alt + alt_ref + alt_alt) AS a, ac_b / (ref_ref + ref_alt + alt_ref + alt_alt) AS b FROM cells) x")
def _(s, d):
    t = dense(s, d).withColumn("n", F.col("ref_ref") + F.col("ref_alt") + F.col("alt_ref") + F.col("alt_alt"))
    return show(t.withColumn("bound", r2_bound(F.col("ac_a"), F.col("ac_b"), F.col("n"))), IDS, ["bound"])


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
