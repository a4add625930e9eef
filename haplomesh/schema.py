"""Column layouts of the engine's tables. Positions are 0-based; bit ``h`` of a word array is haplotype ``h``."""

from __future__ import annotations

CONTIGS = "contig_id INT, contig STRING, n_bases BIGINT"
SAMPLES = "sample_id INT, sample STRING"
VARIANTS = (
    "rid INT, contig STRING, pos INT, ref STRING, alt STRING, ac INT, n_missing INT, n_het INT, n_hom_alt INT, "
    "hwe_p DOUBLE, phased BOOLEAN, flipped BOOLEAN, has_missing BOOLEAN, n_haps INT, hap_bits ARRAY<BIGINT>, miss_bits ARRAY<BIGINT>, variant_id BIGINT"
)
LD_COLUMNS = [
    "flag", "rid_a", "pos_a", "rid_b", "pos_b", "ref_ref", "ref_alt", "alt_ref", "alt_alt",
    "d", "dprime", "r", "r2", "p", "chisq_fisher", "chisq_model",
]

# Bits of the status flag.
FLAGS = {
    "phased": 1, "same_contig": 2, "long_range": 4, "low_cell": 8, "perfect": 16, "multiple_roots": 32,
    "a_missing": 256, "b_missing": 512, "a_rare": 1024, "b_rare": 2048, "a_hwe": 4096, "b_hwe": 8192,
}
LONG_RANGE, RARE, HWE_LIMIT, PERFECT, MIN_CELLS = 500_000, 5, 1e-4, 0.99, 5
