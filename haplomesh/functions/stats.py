"""Statistics of a pair of variants as columns: D, D', R, R2, chi-squared, flags, and the unphased cubic."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haplomesh.schema import FLAGS, HWE_LIMIT, LONG_RANGE, MIN_CELLS, PERFECT, RARE

CELLS = ["ref_ref", "ref_alt", "alt_ref", "alt_alt"]


STATS = ["n", "d", "r2", "dprime", "r", "r_signed", "chisq_fisher"]


def pair_statistics(rr: np.ndarray, ra: np.ndarray, ar: np.ndarray, aa: np.ndarray, compat: bool = False) -> dict[str, np.ndarray]:
    """n, d, r2, dprime, r, r_signed and chisq_fisher of 2x2 cells; NaN where a margin is empty.

    ``compat`` takes the phased bound of the original tool for negative D
    (the smaller of the two margins' variances) in place of the standard one.
    """
    with np.errstate(all="ignore"):
        n = rr + ra + ar + aa
        d = (rr / n) * (aa / n) - (ra / n) * (ar / n)
        g0, g1, h0, h1 = (rr + ra) / n, (ar + aa) / n, (rr + ar) / n, (ra + aa) / n
        var = g0 * g1 * h0 * h1
        negative = -np.minimum(g0 * g1, h0 * h1) if compat else -np.minimum(g0 * h0, g1 * h1)
        limit = np.where(d >= 0, np.minimum(g0 * h1, h0 * g1), negative)
        r2 = np.where(var > 0, d * d / var, np.nan)
        r = np.sqrt(r2)
        return {"n": n, "d": d, "r2": r2, "dprime": np.where(limit != 0, d / limit, np.nan), "r": r, "r_signed": np.sign(d) * r, "chisq_fisher": n * r2}


def with_ld_stats(cells: DataFrame, compat: bool = False) -> DataFrame:
    """Add the statistics of :func:`pair_statistics` (null for NaN) to a stored table of 2x2 cells, in Arrow batches.

    As columns each statistic would repeat the ones below it, beyond what is compiled.
    """
    fields = [f"`{n}` {t}" for n, t in cells.dtypes] + [f"{c} double" for c in STATS]

    def run(batches):
        for batch in batches:
            cell = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.float64) for c in CELLS]
            found = pair_statistics(*cell, compat)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[c], from_pandas=True) for c in STATS)], names=[*batch.schema.names, *STATS])

    return cells.mapInArrow(run, ", ".join(fields))


def usable_cells(rr, ra, ar, aa, d) -> np.ndarray:
    """Enough cells, enough beside the major haplotype, and some disequilibrium."""
    n = rr + ra + ar + aa
    return (n >= MIN_CELLS) & (n - np.maximum(rr, aa) >= MIN_CELLS) & (d != 0) & ~np.isnan(d)


def usable(n: Column | None = None) -> Column:
    """Enough cells, enough beside the major haplotype, and some disequilibrium."""
    n = F.col("n") if n is None else n
    minor = n - F.greatest("ref_ref", "alt_alt")
    return (n >= MIN_CELLS) & (minor >= MIN_CELLS) & (F.col("d") != 0)


def flag_column(phased: Column | bool = True, multiple_roots: Column | bool = False) -> Column:
    """The status flag; null HWE values set no bit."""
    same = F.col("rid_a") == F.col("rid_b")
    tests = {
        "phased": F.lit(phased) if isinstance(phased, bool) else phased,
        "same_contig": same,
        "long_range": same & (F.abs(F.col("pos_b") - F.col("pos_a")) > LONG_RANGE),
        "low_cell": F.least(*CELLS) < 1,
        "perfect": F.col("r2") > PERFECT,
        "multiple_roots": F.lit(multiple_roots) if isinstance(multiple_roots, bool) else multiple_roots,
        "a_missing": F.col("miss_a") > 0,
        "b_missing": F.col("miss_b") > 0,
        "a_rare": F.col("ac_a") < RARE,
        "b_rare": F.col("ac_b") < RARE,
        "a_hwe": F.col("hwe_a") < HWE_LIMIT,
        "b_hwe": F.col("hwe_b") < HWE_LIMIT,
    }
    total = F.lit(0)
    for name, test in tests.items():
        total = total + F.when(test, FLAGS[name]).otherwise(0)
    return total


def log_factorials(top: int) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, top + 1, dtype=np.float64)))])


def grids(low: np.ndarray, high: np.ndarray, budget: int = 1 << 21):
    """(rows, values, mask) over all rows: grids of low .. high, rows of like width together, of about ``budget`` places."""
    width = high - low + 1
    order = np.argsort(width, kind="stable")
    at = 0
    while at < len(order):
        n = max(1, int(np.searchsorted(np.maximum.accumulate(width[order[at:]]) * np.arange(1, len(order) - at + 1), budget, side="right")))
        rows = order[at : at + n]
        values = low[rows, None] + np.arange(int(width[rows].max()))
        yield rows, np.minimum(values, high[rows, None]), values <= high[rows, None]
        at += n


def tail_share(lp: np.ndarray, mask: np.ndarray, seen: np.ndarray, tolerance: float) -> np.ndarray:
    """Per row, the share of the probabilities that are no larger than that at ``seen``."""
    lp = np.where(mask, lp, -np.inf)
    prob = np.exp(lp - lp.max(1, keepdims=True))
    own = prob[np.arange(len(lp)), seen][:, None] * (1 + tolerance)
    return np.minimum(1.0, np.where(prob <= own, prob, 0).sum(1) / prob.sum(1))


def fisher_two_sided(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Two-sided P of each 2x2 table: the tables with its margins that are no more likely, ties included."""
    cells = np.rint(np.stack([a, b, c, d])).astype(np.int64)
    keys, inverse = np.unique(cells, axis=1, return_inverse=True)
    logs = log_factorials(int(cells.sum(0).max(initial=0)))
    out = np.ones(keys.shape[1])
    w, x, y, z = keys
    row, col, n = w + x, w + y, w + x + y + z
    low, high = np.maximum(0, row + col - n), np.minimum(row, col)
    for at, i, mask in grids(low, high):
        r, k, t = row[at, None], col[at, None], n[at, None]
        lp = -(logs[i] + logs[r - i] + logs[k - i] + logs[t - r - k + i])
        out[at] = tail_share(lp, mask, (w - low)[at], 1e-8)
    return out[np.asarray(inverse).ravel()]


def with_fisher(ld: DataFrame) -> DataFrame:
    """Add the exact P in Arrow batches; put it after the cheap filters."""

    @F.pandas_udf("double")
    def fisher(rr: pd.Series, ra: pd.Series, ar: pd.Series, aa: pd.Series) -> pd.Series:
        return pd.Series(fisher_two_sided(*(x.to_numpy(np.float64) for x in (rr, ra, ar, aa))))

    return ld.withColumn("p", fisher(*CELLS))


def hwe_exact(hom_ref: np.ndarray, het: np.ndarray, hom_alt: np.ndarray) -> np.ndarray:
    """Exact Hardy-Weinberg P: heterozygote counts that are no more likely than the one seen; 1 without the rare allele."""
    a, h, b = (np.asarray(x, np.int64) for x in (hom_ref, het, hom_alt))
    n, rare = a + h + b, 2 * np.minimum(a, b) + h
    out = np.ones(len(h))
    logs = log_factorials(int(n.max(initial=0)) * 2)
    some = np.flatnonzero((n > 0) & (rare > 0))
    odd = rare[some] % 2
    for rows, steps, mask in grids(np.zeros(len(some), np.int64), (rare[some] - odd) // 2):
        at = some[rows]
        i, k, t = 2 * steps + odd[rows, None], rare[at, None], n[at, None]
        lp = i * np.log(2.0) - logs[i] - logs[(k - i) // 2] - logs[t - (k + i) // 2]
        out[at] = tail_share(lp, mask, (h[at] - odd[rows]) // 2, 1e-9)
    return out


def hwe_column(hom_ref: Column, het: Column, hom_alt: Column) -> Column:
    @F.pandas_udf("double")
    def hwe(a: pd.Series, h: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(hwe_exact(a.to_numpy(), h.to_numpy(), b.to_numpy()))

    return hwe(hom_ref, het, hom_alt)


NINE = [f"g{i}{j}" for i in range(3) for j in range(3)]
ADDED = "individuals double, p_a double, q_b double, f11 double, chisq_model double, multiple_roots boolean, no_double_het boolean, ref_ref double, ref_alt double, alt_ref double, alt_alt double"


def haplotype_roots(g: np.ndarray) -> dict[str, np.ndarray]:
    """REF-REF haplotype frequency and its fit for rows of nine genotype cells; NaN where no root is valid."""
    n = g.sum(1)
    het = g[:, 4]
    p = (2 * g[:, :3].sum(1) + g[:, 3:6].sum(1)) / (2 * n)
    q = (2 * g[:, 0::3].sum(1) + g[:, 1::3].sum(1)) / (2 * n)
    known = 2 * g[:, 0] + g[:, 1] + g[:, 3]
    a = 4 * n
    b = 2 * n * (1 - 2 * p - 2 * q) - 2 * known - het
    c = -known * (1 - 2 * p - 2 * q) - het * (1 - p - q) + 2 * n * p * q
    d = -known * p * q
    x, w = -b / (3 * a), (b * b - 3 * a * c) / (9 * a * a)
    y, h2 = a * x**3 + b * x * x + c * x + d, 4 * a * a * w**3
    roots = np.full((len(g), 3), np.nan)
    three, one, plain = (y * y < h2) & (het > 0), (y * y > h2) & (het > 0), het == 0
    twice = ~(three | one | plain)
    delta = np.sqrt(np.maximum(w, 0))
    side = np.sqrt(np.maximum(y * y - h2, 0))
    with np.errstate(all="ignore"):
        angle = np.arccos(np.clip(-y / (2 * a * delta**3), -1, 1)) / 3
    for k in range(3):
        roots[three, k] = (x + 2 * delta * np.cos(angle + k * 2 * np.pi / 3))[three]
    roots[one, 0] = (x + np.cbrt((-y + side) / (2 * a)) + np.cbrt((-y - side) / (2 * a)))[one]
    mu = np.cbrt(y / (2 * a))
    roots[twice, 0], roots[twice, 1] = (x + mu)[twice], (x - 2 * mu)[twice]
    roots[plain, 0] = (known / (2 * n))[plain]
    low, high = (known / (2 * n) - 1e-5)[:, None], ((known + het) / (2 * n) + 1e-5)[:, None]
    roots[~((roots >= low) & (roots <= high))] = np.nan
    f00, f01, f10, f11 = roots, p[:, None] - roots, q[:, None] - roots, 1 - p[:, None] - q[:, None] + roots
    expected = [f00 * f00, 2 * f00 * f01, f01 * f01, 2 * f00 * f10, 2 * f01 * f10 + 2 * f00 * f11, 2 * f01 * f11, f10 * f10, 2 * f10 * f11, f11 * f11]
    chi = np.zeros_like(roots)
    for k, e in enumerate(expected):
        e = n[:, None] * e
        with np.errstate(all="ignore"):
            chi += np.where(e > 0, (g[:, k, None] - e) ** 2 / e, 0.0)
    chi[np.isnan(roots)] = np.inf
    best = chi.argmin(1)
    at = np.arange(len(g))
    f = roots[at, best]
    return {
        "individuals": n, "p_a": p, "q_b": q, "f11": f, "chisq_model": chi[at, best], "multiple_roots": (~np.isnan(roots)).sum(1) > 1, "no_double_het": plain,
        "ref_ref": f * 2 * n, "ref_alt": (p - f) * 2 * n, "alt_ref": (q - f) * 2 * n, "alt_alt": (1 - p - q + f) * 2 * n,
    }


def with_unphased_haplotypes(cells9: DataFrame) -> DataFrame:
    """2x2 haplotype cells from 3x3 genotype cells ``g00 .. g22`` (rows A, columns B; 0/0, 0/1, 1/1).

    The frequency of the REF-REF haplotype is a root of the likelihood's cubic.
    Of the valid roots that with the least chi-squared of the 3x3 table is
    taken. Tables without double heterozygotes need no cubic. Rows without a
    valid root, or without individuals, are dropped. The roots are found in
    Arrow batches: as column expressions they are repeated in one another and
    the plan grows beyond what can be compiled.
    """
    fields = [f"{n} {t}" for n, t in cells9.dtypes] + ADDED.split(", ")

    def run(frames):
        for pdf in frames:
            g = pdf[NINE].to_numpy(np.float64)
            pdf = pdf[g.sum(1) > 0].reset_index(drop=True)
            if len(pdf):
                out = pd.concat([pdf, pd.DataFrame(haplotype_roots(pdf[NINE].to_numpy(np.float64)))], axis=1)
                yield out[out.f11.notna()]

    return cells9.mapInPandas(run, ", ".join(fields))
