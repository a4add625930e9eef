"""Filters and interval slices over the pair table. All are predicates that Parquet scans can take."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGES = {
    "r2": "r2", "r": "r", "d": "d", "dprime": "dprime", "p": "p", "ref_ref": "ref_ref", "ref_alt": "ref_alt",
    "alt_ref": "alt_ref", "alt_alt": "alt_alt", "chisq_table": "chisq_fisher", "chisq_model": "chisq_model",
}
CELLS = ["ref_ref", "ref_alt", "alt_ref", "alt_alt"]


def between(name: str, low: float | None = None, high: float | None = None) -> Column:
    """Inclusive range of a named statistic; 'mhc' is the sum of the three smaller cells."""
    c = sum((F.col(x) for x in CELLS), F.lit(0.0)) - F.greatest(*CELLS) if name == "mhc" else F.col(RANGES[name])
    test = F.lit(True)
    if low is not None:
        test = test & (c >= low)
    return test & (c <= high) if high is not None else test


def flags(include: int = 0xFFFF, exclude: int = 0) -> Column:
    """Some included bit is set and no excluded one; with the default include, flag 0 goes once a filter is set."""
    return (F.col("flag").bitwiseAND(include) != 0) & (F.col("flag").bitwiseAND(exclude) == 0)


def upper_triangle() -> Column:
    return (F.col("rid_a") == F.col("rid_b")) & (F.col("pos_a") < F.col("pos_b"))


def lower_triangle() -> Column:
    return (F.col("rid_a") == F.col("rid_b")) & (F.col("pos_b") < F.col("pos_a"))


@dataclass(frozen=True)
class Interval:
    """Positions from 1, both ends included; no ends: the whole contig."""

    contig: str
    start: int | None = None
    stop: int | None = None

    def test(self, rid: Column, pos: Column, ids: dict[str, int]) -> Column:
        t = rid == ids[self.contig]
        return t if self.start is None else t & pos.between(self.start - 1, self.stop - 1)


NUMBER = r"(\d+(?:\.\d+)?(?:[eE]\d)?)"
FORM = re.compile(rf"([^:,]+?)(?::{NUMBER}(?:-{NUMBER})?)?")


def parse_interval(text: str, known: dict[str, int]) -> tuple[Interval, Interval | None]:
    """``contig``, ``contig:pos``, ``contig:a-b``, or two of them with a comma (linked)."""
    parts = text.split(",")
    if not text or len(parts) > 2:
        raise ValueError(f"not an interval: {text!r}")
    out = []
    for part in parts:
        m = FORM.fullmatch(part)
        if not m:
            raise ValueError(f"not an interval: {part!r}")
        contig, a, b = m.groups()
        if contig not in known:
            raise ValueError(f"unknown contig: {contig!r}")
        start = None if a is None else int(float(a))
        stop = start if b is None else int(float(b))
        if start is not None and stop < start:
            raise ValueError(f"interval ends before it starts: {part!r}")
        out.append(Interval(contig, start, stop))
    return out[0], out[1] if len(out) == 2 else None


def slices(texts: list[str], ids: dict[str, int]) -> Column:
    """A side in any interval; where a linked one matches A, the linked ones alone decide."""
    single, linked_a, linked = [], [], []
    for text in texts:
        a, b = parse_interval(text, ids)
        ta = a.test(F.col("rid_a"), F.col("pos_a"), ids)
        if b is None:
            single.append(ta)
        else:
            linked_a.append(ta)
            linked.append(ta & b.test(F.col("rid_b"), F.col("pos_b"), ids))

    def any_of(tests: list[Column]) -> Column:
        out = F.lit(False)
        for t in tests:
            out = out | t
        return out

    return any_of(linked) | (~any_of(linked_a) & any_of(single))


def variant_slices(texts: list[str], ids: dict[str, int]) -> Column:
    """A variant in any of the intervals; a linked pair of them means either side."""
    out = F.lit(False)
    for text in texts:
        for side in parse_interval(text, ids):
            if side is not None:
                out = out | side.test(F.col("rid"), F.col("pos"), ids)
    return out


def slice_by_table(ld: DataFrame, intervals: DataFrame, bin_bp: int = 1_000_000) -> DataFrame:
    """Rows whose A side lies in some interval of a table (rid, start, stop; from 1): an equi-join on position bins."""
    bins = intervals.select("rid", "start", "stop", F.explode(F.sequence(F.floor((F.col("start") - 1) / bin_bp), F.floor((F.col("stop") - 1) / bin_bp))).alias("bin"))
    left = ld.withColumn("_bin", F.floor(F.col("pos_a") / bin_bp))
    on = (left.rid_a == bins.rid) & (left._bin == bins.bin) & (left.pos_a + 1).between(bins.start, bins.stop)
    return left.join(bins, on, "left_semi").drop("_bin")


def view(ld: DataFrame, ranges: dict[str, tuple[float | None, float | None]] | None = None, include: int | None = None, exclude: int | None = None,
         triangle: str | None = None, intervals: list[str] | None = None, ids: dict[str, int] | None = None) -> DataFrame:
    """All filters together."""
    out = ld
    for name, (low, high) in (ranges or {}).items():
        out = out.filter(between(name, low, high))
    if include is not None or exclude is not None:
        out = out.filter(flags(0xFFFF if include is None else include, exclude or 0))
    if triangle:
        out = out.filter(upper_triangle() if triangle == "upper" else lower_triangle())
    return out.filter(slices(intervals, ids or {})) if intervals else out
