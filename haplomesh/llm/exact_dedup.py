"""Exact dedup by composable polynomial fingerprints (operator 1).

A text, without ASCII white space, is read in chunks; each chunk has polynomial
hashes modulo two primes, and chunk hashes combine by arithmetic with the
length-shifted base: ``h(ab) = h(a) * base**len(b) + h(b)``. Documents are
grouped by (fingerprint, length); within a group every text is compared with
that of the group's first candidate, chunk by chunk. A text that differs (a
collision) is grouped by its SHA-256 instead.

Odd input: null text is empty; all empty texts are equal; null ``doc_id`` sorts
after every other; rows that repeat a ``doc_id`` count each in ``group_size``;
rows of one group that share the ``doc_id`` that stays are all marked as kept
(:func:`keep_first` keeps one of them); an empty table gives no rows.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, fresh, id_and_text, mark, materialise, small_batches, tidy, value_bytes, value_offsets

PRIMES = (2147483629, 2147483587)
BASES = (1103515245, 907633385)
CHUNK = 1 << 16  # bytes
SPACE = bytes([32, *range(9, 14)])


class Polynomial:
    """Fingerprints modulo two primes below 2**31, packed in one signed 64-bit number."""

    def __init__(self, primes=PRIMES, bases=BASES, chunk: int = CHUNK):
        self.primes, self.bases, self.chunk = primes, bases, chunk
        self.powers = []
        for p, b in zip(primes, bases, strict=True):
            pows = np.empty(chunk, np.uint64)
            x = 1
            for i in range(chunk):
                pows[i] = x
                x = x * b % p
            self.powers.append(pows)

    def chunk_hash(self, data) -> tuple[int, ...]:
        """Hashes of at most ``chunk`` bytes; each byte counts one more than its value."""
        a = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
        return tuple(int((a * w[: len(a)][::-1]).sum() % np.uint64(p)) for w, p in zip(self.powers, self.primes, strict=True))

    def combine(self, left: tuple, right: tuple, right_length: int) -> tuple[int, ...]:
        """Hashes of the concatenation, from those of its parts."""
        return tuple((a * pow(b, right_length, p) + c) % p for a, c, b, p in zip(left, right, self.bases, self.primes, strict=True))

    def of(self, data) -> tuple[int, ...]:
        out, view = (0,) * len(self.primes), memoryview(data)
        for at in range(0, len(view), self.chunk):
            part = view[at : at + self.chunk]
            out = self.combine(out, self.chunk_hash(part), len(part)) if at else self.chunk_hash(part)
        return out

    @staticmethod
    def packed(hashes: tuple[int, ...]) -> int:
        return hashes[0] << 32 | hashes[1]


def digests(docs: DataFrame, poly: Polynomial | None = None) -> DataFrame:
    """Per row: doc_id, fp, n_bytes (normalised), n_points and mark (original), text_sha256."""
    rows = Rows(doc_id="long", mark="long", fp="long", n_bytes="long", n_points="long", text_sha256="string")

    def run(batches):
        p = poly or Polynomial()
        for batch in small_batches(batches):
            col = batch.column(1)
            at, data = value_offsets(col).tolist(), value_bytes(col)
            fp, size, sha = [], [], []
            for a, b in zip(at, at[1:]):
                text = bytes(data[a:b]).translate(None, SPACE)
                fp.append(p.packed(p.of(text)))
                size.append(len(text))
                sha.append(sha256(text).hexdigest())
            yield rows.batch(batch.column(0), batch.column(2), fp, size, pc.utf8_length(col).cast("int64"), sha)

    return marked(docs).mapInArrow(tidy(run), rows.schema)


def marked(docs: DataFrame) -> DataFrame:
    return id_and_text(docs).withColumn("mark", mark(F.col("text")))


def same_text(a: str, b: str, chunk: int = CHUNK) -> bool:
    """Whether two texts are equal without white space, comparing chunk after chunk."""
    parts = []
    for t in (a, b):
        raw = memoryview(t.encode())
        parts.append(iter([raw[k : k + chunk] for k in range(0, len(raw), chunk)]))
    left = right = b""
    while True:
        if not left:
            left = next((x for x in (bytes(c).translate(None, SPACE) for c in parts[0]) if x), b"")
        if not right:
            right = next((x for x in (bytes(c).translate(None, SPACE) for c in parts[1]) if x), b"")
        n = min(len(left), len(right))
        if not n:
            return not left and not right
        if left[:n] != right[:n]:
            return False
        left, right = left[n:], right[n:]


#: Sorts the larger text first, then the smaller doc_id; a null doc_id comes last.
FIRST = "struct(n_points, doc_id IS NOT NULL AS known, -doc_id AS neg)"
KEY = ["fp", "n_bytes"]


def colliding(docs: DataFrame, base: DataFrame) -> DataFrame:
    """``fp, n_bytes, text_sha256`` of the texts that differ from the first text of their fingerprint group.

    Only texts of groups of two or more are fetched, by (doc_id, mark), so that
    neither null nor repeated ids meet other rows' texts, and are compared with
    their group's first text: that side is a table of one row a group, so the
    adaptive skew join can split a group that holds a large share of the rows.
    """
    groups = base.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max(F.expr(FIRST)).alias("first")).filter("n > 1")
    groups = materialise(groups.select(*KEY, (-F.col("first.neg")).alias("lead_id")), "groups")
    members = base.join(groups, KEY).select(F.col("doc_id").alias("member"), F.col("mark").alias("member_mark"), *KEY, "lead_id", "text_sha256").distinct()
    texts = marked(docs).join(members, F.col("doc_id").eqNullSafe(F.col("member")) & (F.col("mark") == F.col("member_mark"))).drop("member", "member_mark")
    bare = F.translate("text", SPACE.decode(), "")
    texts = materialise(texts.filter(F.sha2(bare, 256) == F.col("text_sha256")).select("doc_id", "text", *KEY, "lead_id", "text_sha256"), "texts")
    leads = texts.filter(F.col("doc_id").eqNullSafe(F.col("lead_id"))).select(*KEY, F.col("text").alias("lead_text"))
    leads = materialise(leads.groupBy(*KEY).agg(F.min("lead_text").alias("lead_text")), "leads")
    rows = Rows(fp="long", n_bytes="long", text_sha256="string", same="boolean")

    def compare(batches):
        for batch in batches:
            for part in small_batches([batch]):
                text, fp, size, sha, lead = part.columns
                same = [same_text(a, b) for a, b in zip(text.to_pylist(), lead.to_pylist(), strict=True)]
                yield rows.batch(fp, size, sha, same)

    pairs = texts.join(leads, KEY).select("text", *KEY, "text_sha256", "lead_text")
    return pairs.mapInArrow(tidy(compare), rows.schema).filter("NOT same").select(*KEY, "text_sha256").distinct()


def exact_dedup(docs: DataFrame, poly: Polynomial | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``."""
    return decided(docs, poly).drop("n_points", "mark")


def decided(docs: DataFrame, poly: Polynomial | None = None) -> DataFrame:
    """The rows of :func:`exact_dedup` with the original text's length and mark."""
    base = materialise(digests(docs, poly), "fingerprints")
    odd = materialise(colliding(docs, base), "collisions")
    group = F.lit("")
    if not odd.isEmpty():
        base = base.join(odd.withColumn("odd", F.lit(True)), [*KEY, "text_sha256"], "left")
        group = F.when(F.col("odd"), F.col("text_sha256")).otherwise("")
    base = base.withColumn("own", group)
    key = [*KEY, "own"]
    groups = base.groupBy(*key).agg(F.count(F.lit(1)).alias("group_size"), F.max(F.expr(FIRST)).alias("first"))
    groups = materialise(groups.select(*key, "group_size", (-F.col("first.neg")).alias("keep_id")), "classes")
    out = base.join(groups, key)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_points", "mark")


def keep_first(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of ``docs`` for each text: the longest original, then the smallest id; all its columns.

    Rows that share the id and the normalised text are told apart by their
    text; of rows that share both, one stays.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = materialise(decided(own), "decided").filter("kept")
    best = found.groupBy("text_sha256").agg(F.max(F.struct("n_points", F.struct("doc_id", "mark").alias("row"))).alias("best"), F.count(F.lit(1)).alias("n"))
    best = materialise(best.select(F.col("best.row.doc_id").alias("keep_id"), F.col("best.row.mark").alias("keep_mark"), (F.col("n") > 1).alias("repeated")), "first")
    names = docs.columns
    at, text_mark, again = (fresh(n, names) for n in ("_keep", "_mark", "_again"))
    best = best.select(F.col("keep_id").alias(at), F.col("keep_mark").alias(text_mark), F.col("repeated").alias(again))
    on = F.col(id_col).cast("long").eqNullSafe(F.col(at)) & (mark(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col(text_mark))
    kept = docs.join(best, on)
    if best.filter(again).isEmpty():
        return kept.select(*names)
    once = kept.filter(again).dropDuplicates([at, text_mark])  # aggregated before the shuffle
    return kept.filter(~F.col(again)).unionByName(once).select(*names)
