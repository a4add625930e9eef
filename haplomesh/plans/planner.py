"""The whole LD computation; the r2 bound as a column, and a rule for callers that choose between the dense tiles and the sparse join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haplomesh.functions.stats import CELLS, flag_column, haplotype_roots, pair_statistics, usable_cells, with_fisher
from haplomesh.operators.pairs import NINE, PAIR_TYPES, mirrored, pair_cells
from haplomesh.schema import LD_COLUMNS


def r2_bound(ac_a: Column, ac_b: Column, n: Column) -> Column:
    """Largest r2 that two ALT counts allow; exact where no allele is missing."""
    pa, pb = ac_a / n, ac_b / n
    qa, qb = 1 - pa, 1 - pb
    plus, minus = F.least(pa * qb, qa * pb), F.least(pa * pb, qa * qb)
    return F.greatest(plus * plus, minus * minus) / F.nullif(pa * qa * pb * qb, F.lit(0.0))


def choose_kernel(variants: DataFrame, limit: float = 0.02) -> str:
    """'sparse' where carriers are rare (their pairs cost less than the dense products), else 'dense'."""
    row = variants.agg(F.avg(F.col("ac") / F.col("n_haps")).alias("f"), F.max("n_missing").alias("m")).head()
    return "sparse" if row.f is not None and row.f < limit and not row.m else "dense"


ROWS = ["rid_a", "pos_a", "rid_b", "pos_b", "variant_id_a", "variant_id_b", "ac_a", "ac_b", "miss_a", "miss_b", "hwe_a", "hwe_b"]
NUMBERS = [*CELLS, "d", "dprime", "r", "r2", "r_signed", "chisq_fisher", "chisq_model"]


def compute_ld(
    variants: DataFrame, model: str = "auto", min_r2: float = 0.1, max_r2: float = 100.0, min_dprime: float = 0.0, max_dprime: float = 100.0,
    max_p: float = 1.0, exact_p: bool = True, mirror: bool = True, compat: bool = False, **where,
) -> DataFrame:
    """The pair table: cells, D, D', R, R2, exact P, chi-squared and flags.

    The statistics are computed beside the cells, inside the tile, and cheap
    tests come first: allele counts, cells, D, R2, D'; only the pairs that pass
    are rows, and the exact test runs on those.
    """
    ddl = ", ".join(f"{c} {PAIR_TYPES[c[:-2]]}" for c in ROWS) + ", " + ", ".join(f"{c} double" for c in NUMBERS) + ", math_phased boolean, multiple_roots boolean"

    def finish(out: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        phased = out["pair_phased"]
        keep = np.ones(len(phased), bool)
        out |= {"chisq_model": np.zeros(len(phased)), "math_phased": phased.copy(), "multiple_roots": np.zeros(len(phased), bool)}
        for c in CELLS:
            out.setdefault(c, np.zeros(len(phased)))
        at = np.flatnonzero(~phased)
        if len(at):
            nine = np.stack([out[c][at] for c in NINE], axis=1)
            with np.errstate(all="ignore"):
                roots = haplotype_roots(nine)
            keep[at] = (nine.sum(1) > 0) & ~np.isnan(roots["f11"])
            for c in (*CELLS, "chisq_model", "multiple_roots"):
                out[c][at] = roots[c]
            out["math_phased"][at] = roots["no_double_het"]
        cells = [out[c] for c in CELLS]
        out |= pair_statistics(*cells, compat)
        with np.errstate(invalid="ignore"):
            keep &= usable_cells(*cells, out["d"]) & (out["r2"] >= min_r2) & (out["r2"] <= max_r2) & (out["dprime"] >= min_dprime) & (out["dprime"] <= max_dprime)
        return {c: out[c][keep] for c in (*ROWS, *NUMBERS, "math_phased", "multiple_roots")}

    bound = min_r2 if model == "phased" and min_r2 > 0 else None
    out = pair_cells(variants, model=model, min_r2=bound, finish=finish, ddl=ddl, **where)
    out = with_fisher(out).filter(F.col("p") <= max_p) if exact_p else out.withColumn("p", F.lit(None).cast("double"))
    out = mirrored(out) if mirror else out
    out = out.withColumn("flag", flag_column(F.col("math_phased"), F.col("multiple_roots")))
    return out.select(*LD_COLUMNS, "r_signed")
