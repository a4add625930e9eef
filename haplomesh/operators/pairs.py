"""Which pairs of variants, and their contingency cells.

The pair space is cut into square tiles of super-blocks, each of some blocks of
variants. A variant is sent to the tiles of its super-block's row and column
only, so a task holds two super-blocks whatever the number of variants, and
visits block by block: matrix products of 0/1 matrices give the cells, and at
most block * block pairs are rows at once. Windows keep the tiles, and inside
them the blocks, whose positions are in reach. The sparse path joins carriers
of the ALT allele instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplomesh.functions.stats import CELLS

BLOCK = 500
SIDES = ["variant_id", "rid", "pos", "ac", "miss", "hwe"]
PAIR_TYPES = {"variant_id": "bigint", "rid": "int", "pos": "int", "ac": "int", "miss": "int", "hwe": "double"}


def _prepared(variants: DataFrame) -> DataFrame:
    names = set(variants.columns)
    return variants.select(
        F.col("variant_id").cast("long").alias("variant_id"), F.col("rid").cast("int").alias("rid"), F.col("pos").cast("int").alias("pos"),
        F.col("ac").cast("int").alias("ac"), F.col("n_missing").cast("int").alias("miss"),
        (F.col("hwe_p") if "hwe_p" in names else F.lit(None)).cast("double").alias("hwe"),
        (~F.col("phased") if "phased" in names else F.lit(False)).alias("unphased"), "n_haps", "hap_bits", "miss_bits",
    )


MOST_SIDE = 32  # blocks on a side of a tile at most


def tiled(variants: DataFrame, block: int = BLOCK, window: int | None = None, side: int | None = None) -> DataFrame:
    """Variants with the tile (t_rid, x, y), their super-block and block, one row for each tile they go to.

    Blocks are cut by ``variant_id``, which grows with the position, so they are
    bounded by count however dense a region is. ``side``: blocks of a tile's side.
    """
    v = _prepared(variants).withColumn("blk", F.floor(F.col("variant_id") / block).cast("long"))
    if window is None:
        top = variants.agg(F.max(F.col("variant_id").cast("long"))).head()[0] or 0
        blocks = int(top) // block + 1
        if side is None:  # tiles enough for the cluster's cores, and no more copies than that needs
            wanted = int(np.ceil(np.sqrt(8 * variants.sparkSession.sparkContext.defaultParallelism)))
            side = max(1, min(MOST_SIDE, blocks // wanted))
        v = v.withColumn("t_rid", F.lit(-1)).withColumn("sup", F.floor(F.col("blk") / side).cast("long"))
        v = v.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // side).cast("long"))))
    else:
        v = v.withColumn("t_rid", F.col("rid")).withColumn("sup", F.floor(F.col("blk") / (side or 8)).cast("long"))
        spans = v.groupBy("t_rid", "sup").agg(F.min("pos").alias("low"), F.max("pos").alias("high"))  # a row a super-block
        one, two = (spans.select("t_rid", *[F.col(c).alias(f"{c}{k}") for c in ("sup", "low", "high")]) for k in (1, 2))
        near = one.join(two, "t_rid").filter((F.col("low2") <= F.col("high1") + window) & (F.col("low1") <= F.col("high2") + window))
        v = v.join(near.select("t_rid", F.col("sup1").alias("sup"), F.col("sup2").alias("other")), ["t_rid", "sup"])
    return v.withColumn("x", F.least("sup", "other")).withColumn("y", F.greatest("sup", "other")).drop("other")


def unpack(words: pd.Series, haps: int, start: int = 0) -> np.ndarray:
    """0/1 matrix of bit arrays, of the haplotypes from ``start`` (a multiple of 64) up to ``haps``."""
    grid = np.stack([np.asarray(w, np.int64)[start // 64 : -(-haps // 64)] for w in words]).view(np.uint8)
    return np.unpackbits(grid, axis=1, bitorder="little")[:, : haps - start]


SPAN = 1 << 24  # places of a 0/1 matrix at most; also below what float32 counts exactly


def spans(haps: int, rows: int, span: int = SPAN) -> list[tuple[int, int]]:
    """Ranges of haplotypes, whole words each, of which ``rows`` variants make a matrix of ``span`` places."""
    step = max(64, span // max(1, rows) // 64 * 64)
    return [(at, min(at + step, haps)) for at in range(0, haps, step)]


def phased_cells(a: np.ndarray, b: np.ndarray, ma: np.ndarray | None, mb: np.ndarray | None) -> list[np.ndarray]:
    """ref_ref, ref_alt, alt_ref, alt_alt of every row pair; haplotypes missing in either are left out."""
    a, b = a.astype(np.float32), b.astype(np.float32)
    if ma is None and mb is None:  # margins give three of the cells
        aa = a @ b.T
        ar = a.sum(1)[:, None] - aa
        ra = b.sum(1)[None, :] - aa
        return [a.shape[1] - aa - ar - ra, ra, ar, aa]
    ka = np.ones_like(a) if ma is None else 1 - ma.astype(np.float32)
    kb = np.ones_like(b) if mb is None else 1 - mb.astype(np.float32)
    a, b = a * ka, b * kb
    return [(ka - a) @ (kb - b).T, (ka - a) @ b.T, a @ (kb - b).T, a @ b.T]


def genotype_cells(a: np.ndarray, b: np.ndarray, ma: np.ndarray | None, mb: np.ndarray | None) -> list[np.ndarray]:
    """The nine genotype cells g00 .. g22; samples missing in either are left out."""

    def planes(h, m):
        if h.shape[1] % 2:  # the last haplotype is its sample's whole dose
            h, m = (x if x is None else np.pad(x, ((0, 0), (0, 1))) for x in (h, m))
        dose = h[:, 0::2].astype(np.int8) + h[:, 1::2]
        called = np.ones_like(dose, bool) if m is None else (m[:, 0::2] + m[:, 1::2]) == 0
        return [((dose == k) & called).astype(np.float32) for k in range(3)]

    pa, pb = planes(a, ma), planes(b, mb)
    return [x @ y.T for x in pa for y in pb]


NINE = [f"g{i}{j}" for i in range(3) for j in range(3)]
TURNED = {"ref_alt": "alt_ref", "alt_ref": "ref_alt"} | {f"g{i}{j}": f"g{j}{i}" for i in range(3) for j in range(3)}
VALUES = {"phased": CELLS, "unphased": NINE, "auto": [*CELLS, *NINE]}


def pair_cells(
    variants: DataFrame, model: str = "phased", window: int | None = None, block: int = BLOCK, side: int | None = None,
    min_r2: float | None = None, skip_rare: bool = True, contigs: str = "any", chunk: tuple[int, int] | None = None, finish=None, ddl: str | None = None, span: int = SPAN,
) -> DataFrame:
    """One row per unordered pair, the earlier variant as A: both variants' columns with suffixes, and cells.

    model: 'phased' (2x2), 'unphased' (3x3: g00 .. g22) or 'auto' (both sets of
    columns; ``pair_phased`` says which holds: unphased where a variant of the
    pair has missing alleles or is flagged unphased). min_r2 drops phased pairs
    inside the tile, before they are rows; where no allele is missing, blocks of
    pairs whose allele counts cannot reach it are not even multiplied. chunk:
    (number of chunks k(k+1)/2, chunk) of the block triangle. contigs: 'any',
    'same' or 'different'. finish (a function of a dict of column arrays that
    returns such a dict, of the columns of ``ddl``) makes other rows of the pairs.
    Cells are summed over spans of haplotypes, of ``span`` places a matrix, so a
    task's memory does not grow with their number beyond the bits.
    """
    tiles = tiled(variants, block, window, 1 if chunk is not None else side)
    if chunk is not None:
        tiles = tiles.filter(chunk_of("x", "y", chunk[0], tiles) == chunk[1])
    value_names = VALUES[model]
    ddl = ddl or ", ".join(f"{c}_{s} {PAIR_TYPES[c]}" for s in "ab" for c in SIDES) + ", pair_phased boolean, " + ", ".join(f"{c} double" for c in value_names)
    names = [c.split()[0] for c in ddl.split(", ")]

    def product(left: pd.DataFrame, right: pd.DataFrame, haps: int, same_block: bool, held: list[np.ndarray]) -> pd.DataFrame | None:
        """The kept pairs of two blocks; ``held`` keeps the left one's 0/1 matrix for the other calls of its row."""
        col = lambda f, c: f[c].to_numpy()
        keep = np.triu(np.ones((len(left), len(right)), bool), 1) if same_block else np.ones((len(left), len(right)), bool)
        ac_a, ac_b = col(left, "ac").astype(np.float64), col(right, "ac").astype(np.float64)
        if skip_rare:
            keep &= ac_a[:, None] + ac_b[None, :] > 2
        same = col(left, "rid")[:, None] == col(right, "rid")[None, :]
        if contigs != "any":
            keep &= same if contigs == "same" else ~same
        if window is not None:
            gap = np.abs(col(right, "pos")[None, :].astype(np.int64) - col(left, "pos")[:, None])
            keep &= same & (gap <= window)
        clean = not (left.miss.any() or right.miss.any())
        if min_r2 is not None and model == "phased" and clean:
            keep &= r2_ceiling(ac_a[:, None], ac_b[None, :], haps) >= min_r2 - 1e-9
        if not keep.any():
            return None
        if model == "phased" and clean:  # ALT_ALT alone is multiplied, and the margins give the rest for the pairs that stay
            ranges = spans(haps, max(len(left), len(right)), span)
            common, sa, sb = np.zeros(keep.shape), np.zeros(len(left)), np.zeros(len(right))
            for low, high in ranges:
                a = held[0] if held else unpack(left.hap_bits, high, low).astype(np.float32)
                if len(ranges) == 1 and not held:
                    held.append(a)
                b = a if same_block else unpack(right.hap_bits, high, low).astype(np.float32)
                common += a @ b.T
                sa += a.sum(1, dtype=np.float64)
                sb += b.sum(1, dtype=np.float64)
            if min_r2 is not None:
                cov = haps * common - np.outer(sa, sb)
                var = np.outer(sa * (haps - sa), sb * (haps - sb))
                keep &= (var > 0) & (cov * cov >= (min_r2 - 1e-9) * var)
            i, j = np.nonzero(keep)
            aa, ar, ra = common[i, j], sa[i] - common[i, j], sb[j] - common[i, j]
            return rows(left, right, i, j, [haps - aa - ar - ra, ra, ar, aa])
        cells = [np.zeros(keep.shape) for _ in value_names]
        for low, high in spans(haps, max(len(left), len(right)), span):
            a, b = unpack(left.hap_bits, high, low), unpack(right.hap_bits, high, low)
            ma = unpack(left.miss_bits, high, low) if left.miss.any() else None
            mb = unpack(right.miss_bits, high, low) if right.miss.any() else None
            found = phased_cells(a, b, ma, mb) if model != "unphased" else []
            found = found + genotype_cells(a, b, ma, mb) if model != "phased" else found
            for cell, more in zip(cells, found, strict=True):
                cell += more
        if min_r2 is not None and model == "phased":
            rr, ra, ar, aa = cells
            var = (rr + ra) * (ar + aa) * (rr + ar) * (ra + aa)
            cov = rr * aa - ra * ar
            keep &= (var > 0) & (cov * cov >= (min_r2 - 1e-9) * var)
        i, j = np.nonzero(keep)
        return rows(left, right, i, j, [m[i, j] for m in cells])

    def rows(left: pd.DataFrame, right: pd.DataFrame, i: np.ndarray, j: np.ndarray, values: list[np.ndarray]) -> pd.DataFrame | None:
        """The pairs (i, j) with their cells, turned so that A is the earlier variant, and finished."""
        if not len(i):
            return None
        col = lambda f, c: f[c].to_numpy()
        unphased = (col(left, "unphased") | (col(left, "miss") > 0))[i] | (col(right, "unphased") | (col(right, "miss") > 0))[j]
        out = {f"{c}_a": col(left, c)[i] for c in SIDES} | {f"{c}_b": col(right, c)[j] for c in SIDES}
        out["pair_phased"] = np.full(len(i), True) if model == "phased" else np.full(len(i), False) if model == "unphased" else ~unphased
        out |= dict(zip(value_names, values, strict=True))
        turn = (out["rid_a"] > out["rid_b"]) | ((out["rid_a"] == out["rid_b"]) & (out["pos_a"] > out["pos_b"]))
        if turn.any():
            out = {c: np.where(turn, out[turned(c)], v) if turned(c) in out else v for c, v in out.items()}
        out = finish(out) if finish else out
        return pd.DataFrame({c: out[c] for c in names}) if len(out[names[0]]) else None

    def kernel(key: tuple[Any, ...], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, x, y = key
        pdf = pd.concat(list(frames)).sort_values(["rid", "pos", "variant_id"], kind="stable")
        haps = int(pdf.n_haps.max())
        cut = {s: [f.reset_index(drop=True) for _, f in pdf[pdf["sup"] == s].groupby("blk")] for s in {x, y}}
        for i, left in enumerate(cut[x]):
            held: list[np.ndarray] = []
            for j, right in enumerate(cut[y]):
                if x == y and j < i:
                    continue
                if window is not None and (right.pos.min() > left.pos.max() + window or left.pos.min() > right.pos.max() + window):
                    continue
                found = product(left, right, haps, x == y and i == j, held)
                if found is not None:
                    yield found

    return tiles.groupBy("t_rid", "x", "y").applyInPandas(kernel, ddl)


def r2_ceiling(ac_a, ac_b, n: float) -> np.ndarray:
    """Largest r2 that two ALT counts of ``n`` haplotypes allow; 0 where one is monomorphic."""
    pa, pb = np.broadcast_arrays(ac_a / n, ac_b / n)
    qa, qb = 1 - pa, 1 - pb
    best = np.maximum(np.minimum(pa * qb, qa * pb), np.minimum(pa * pb, qa * qb)) ** 2
    var = pa * qa * pb * qb
    return np.divide(best, var, out=np.zeros_like(var), where=var > 0)


def turned(c: str) -> str:
    """The column that takes ``c``'s place when the sides of a pair are exchanged."""
    if c[-2:] in ("_a", "_b") and c[:-2] in SIDES:
        return c[:-1] + ("b" if c[-1] == "a" else "a")
    return TURNED.get(c, c)


def oriented(pairs: DataFrame, swap) -> DataFrame:
    """Pairs with their sides exchanged where ``swap`` holds; the off-diagonal cells follow."""
    return pairs.select(*[F.when(swap, F.col(turned(c))).otherwise(F.col(c)).alias(c) if turned(c) in pairs.columns and turned(c) != c else F.col(c) for c in pairs.columns])


def mirrored(pairs: DataFrame) -> DataFrame:
    """Every pair in both directions; one scan of the input."""
    twice = pairs.withColumn("_turn", F.explode(F.array(F.lit(False), F.lit(True))))
    return oriented(twice, F.col("_turn")).drop("_turn")


def chunk_of(x: str, y: str, chunks: int, tiles: DataFrame):
    """Chunk number of a tile; chunks must be k(k+1)/2 and not more than the blocks allow."""
    k = int((np.sqrt(8 * chunks + 1) - 1) / 2)
    if k * (k + 1) // 2 != chunks:
        raise ValueError(f"{chunks} is not k(k+1)/2 for a whole k")
    blocks = int(tiles.agg(F.max("y")).head()[0] or 0) + 1
    if k > blocks:
        raise ValueError(f"{chunks} chunks of {blocks} blocks")
    i, j = F.floor(F.col(x) * k / blocks), F.floor(F.col(y) * k / blocks)
    return (i * k - i * (i - 1) / 2 + j - i).cast("int")


def target_region(variants: DataFrame, rid: int, start: int, stop: int, flank: int = 500_000, block: int = BLOCK) -> DataFrame:
    """Pairs of targets in [start, stop] (1-based) with each other and with their neighbours within ``flank``."""
    one = F.col("pos") + 1
    near = variants.filter((F.col("rid") == rid) & one.between(max(0, start - flank), stop + flank))
    if near.filter(one.between(start, stop)).isEmpty():
        raise ValueError("no target variant in the region")
    if near.filter(~one.between(start, stop)).isEmpty():
        raise ValueError("the targets have no neighbours")
    pairs = pair_cells(near, block=block, window=2 * flank + stop - start + 1, skip_rare=False)  # the window holds the whole region
    return pairs.filter((F.col("pos_a") + 1).between(start, stop) | (F.col("pos_b") + 1).between(start, stop))


def sparse_cells(carriers: DataFrame, n: int, hap: str = "hap_idx", variant: str = "variant_id") -> DataFrame:
    """Cells of the pairs that share a carrier, from (variant, haplotype) rows of the ALT allele.

    Only ALT_ALT is counted; the margins give the other cells. Pairs without a
    common carrier are absent: their R2 is at most the product of both odds.
    """
    rows = carriers.select(F.col(variant).alias("v"), F.col(hap).alias("h")).distinct()
    margins = rows.groupBy("v").agg(F.count(F.lit(1)).alias("ac"))
    a, b = rows.select(F.col("v").alias("variant_id_a"), "h"), rows.select(F.col("v").alias("variant_id_b"), "h")
    common = a.join(b, "h").filter("variant_id_a < variant_id_b").groupBy("variant_id_a", "variant_id_b").agg(F.count(F.lit(1)).cast("double").alias("alt_alt"))
    out = common.join(margins.select(F.col("v").alias("variant_id_a"), F.col("ac").alias("ac_a")), "variant_id_a")
    out = out.join(margins.select(F.col("v").alias("variant_id_b"), F.col("ac").alias("ac_b")), "variant_id_b")
    aa = F.col("alt_alt")
    out = out.withColumn("alt_ref", F.col("ac_a") - aa).withColumn("ref_alt", F.col("ac_b") - aa)
    return out.withColumn("ref_ref", n - aa - F.col("alt_ref") - F.col("ref_alt"))


def bit_cells(pairs: DataFrame) -> DataFrame:
    """Cells of given pairs from their bit arrays (``hap_bits_a``, ``hap_bits_b``, ``ac_a``, ``ac_b``, ``n_haps``), without Python."""
    words = F.zip_with("hap_bits_a", "hap_bits_b", lambda x, y: F.bit_count(x.bitwiseAND(y)))
    aa = F.aggregate(words, F.lit(0), lambda s, x: s + x).cast("double")
    out = pairs.withColumn("alt_alt", aa)
    out = out.withColumn("alt_ref", F.col("ac_a") - F.col("alt_alt")).withColumn("ref_alt", F.col("ac_b") - F.col("alt_alt"))
    return out.withColumn("ref_ref", F.col("n_haps") - F.col("alt_alt") - F.col("alt_ref") - F.col("ref_alt"))
