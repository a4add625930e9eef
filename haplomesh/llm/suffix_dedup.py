"""Suffix-array dedup over sparse suffixes (operator 5).

Only suffixes that begin at minimisers of word k-grams are kept: with a window
of ``least - k + 1`` positions, every passage of ``least`` words that two texts
share holds a minimiser of both at the same place, at most ``window - 1`` words
from its start. Suffixes whose k-gram occurs once are dropped; the rest, with
the words that follow the k-gram and precede it, are sorted twice over range
partitions, by (k-gram, words that follow, document, place) and by (k-gram,
words that precede, document, place), so that a passage in many documents
spreads over tasks. Each suffix is compared with its neighbours in both orders,
and matches are extended to the right and left over the carried words, which
are as many as a passage of ``least`` words around this minimiser can have. A
match of ``least`` words or more marks its place in both documents. The places
of one document are united, which extends a match without bound: each next
``least`` words of a longer passage hold a minimiser that is less than a window
on, and its match overlaps. In each order the first and last suffix of each
partition are compared in a second, small step, so no neighbours are missed.

Words are runs of characters other than white space; positions are word
numbers from 0, ends exclusive. Odd input: null and empty texts, and texts
under ``least`` words, have no spans; a passage repeated in one document counts
(overlapping shifts of a periodic text too); rows that repeat a ``doc_id`` are
repeats of each other, each with its own text's places; rows of null ``doc_id``
take no part; a very long text is cut at its minimisers in one task and its
places are united by a spilling sort; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Rows, id_and_text, mark, materialise, release_shuffles, setting, small_batches
from .shingles import grams, word_hashes

LEAST, K = 50, 16
CHUNK = 1 << 15  # suffixes that are compared at once
SAMPLED = 24  # keys a partition that the driver sees when it sets the ranges


def minimisers(h: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, k-gram hashes) of the least hash in every window; ties go to the right."""
    if len(h) < k:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    g = grams(h, k)
    w = min(window, len(g))
    view = np.lib.stride_tricks.sliding_window_view(g[::-1], w)
    at = view.argmin(1) + np.arange(len(view))  # the first in reversed order is the rightmost
    at = np.unique(len(g) - 1 - at)
    return at, g[at]


def contexts(h: np.ndarray, at: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``reach`` 32-bit word codes from ``at`` on and before ``at`` (nearest first); 0 beyond the text."""
    code = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    padded = np.concatenate([np.zeros(reach, np.uint32), code, np.zeros(reach, np.uint32)])
    steps = np.arange(reach)
    return padded[reach + at[:, None] + steps], padded[reach + at[:, None] - 1 - steps]


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the equal beginning of each pair of rows; words beyond a text's end equal nothing."""
    differs = (a != b) | (a == 0)
    return np.where(differs.any(1), differs.argmax(1), a.shape[1])


def stretches(key, right, left, doc, pos, cut, least, k):
    """Of suffixes in order, (place in the rows, start, end, other doc) of those that match a neighbour in ``least`` words.

    ``cut``: whether each suffix is not a neighbour of the one before it. A
    suffix that matches both neighbours gets the union, and the lesser document.
    """
    r, back = common_prefix(right[1:], right[:-1]) + k, common_prefix(left[1:], left[:-1])
    ok = (key[1:] == key[:-1]) & ~cut[1:] & (r + back >= least)
    none = np.iinfo(np.int64).max
    start, end, other = (np.full(len(key), v, np.int64) for v in (none, -1, none))
    for side, mate in ((slice(1, None), slice(None, -1)), (slice(None, -1), slice(1, None))):
        start[side] = np.where(ok, np.minimum(start[side], pos[side] - back), start[side])
        end[side] = np.where(ok, np.maximum(end[side], pos[side] + r), end[side])
        other[side] = np.where(ok, np.minimum(other[side], doc[mate]), other[side])
    at = np.flatnonzero(end >= 0)
    return at, start[at], end[at], other[at]


def suffix_dedup(docs: DataFrame, least: int = LEAST, k: int = K) -> DataFrame:
    """``doc_id, start, length, other_id`` of every maximal repeated stretch of ``least`` words or more.

    ``other_id`` is the least document found to share a part of the stretch (the
    document itself for a repeat within it).
    """
    spark = docs.sparkSession
    window = least - k + 1
    reach = window - 1  # words on either side of the k-gram that a passage of ``least`` words can have
    texts = id_and_text(docs).filter("doc_id IS NOT NULL").withColumn("mark", mark(F.col("text")))
    entry = Rows(doc_id="long", mark="long", pos="int", gram="long")

    def sample(batches):
        for batch in small_batches(batches, 1 << 20):
            counts, places, found = [], [], []
            for text in batch.column(1).to_pylist():
                at, g = minimisers(word_hashes(text.split()), k, window)
                counts.append(len(at))
                places.append(at)
                found.append(g)
            owner = [np.repeat(batch.column(c).to_numpy(), counts) for c in (0, 2)]
            yield entry.batch(*owner, np.concatenate(places).astype(np.int32), np.concatenate(found).view(np.int64))

    entries = materialise(texts.mapInArrow(sample, entry.schema), "minimisers")
    repeated = entries.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram")
    kept = entries.join(materialise(repeated, "repeated"), "gram").select(F.col("doc_id").alias("owner"), F.col("mark").alias("own_mark"), "pos", "gram")
    # Suffixes meet their text by document and text; a text's own suffixes are bounded by its length.
    per_doc = kept.groupBy("owner", "own_mark").agg(F.collect_set(F.struct("pos")).alias("at"))
    joined = texts.join(per_doc, (F.col("doc_id") == F.col("owner")) & (F.col("mark") == F.col("own_mark"))).select("doc_id", "mark", "text", F.col("at.pos").alias("at"))
    suffix = Rows(gram="long", right="binary", left="binary", doc_id="long", mark="long", pos="int")

    def cut(batches):
        for batch in small_batches(batches, 256 << 10):
            for doc_id, text_mark, text, at in zip(*(c.to_pylist() for c in batch.columns)):
                h = word_hashes(text.split())
                at = np.sort(np.asarray(at, np.int64))
                right, left = contexts(h, at + k, reach)[0], contexts(h, at, reach)[1]
                sides = ([x.tobytes() for x in side.astype(">u4")] for side in (right, left))  # big-endian, so that bytes sort as the codes do
                yield suffix.batch(grams(h, k)[at].view(np.int64), *sides, [doc_id] * len(at), [text_mark] * len(at), at)

    suffixes = materialise(joined.mapInArrow(cut, suffix.schema), "suffixes")
    release_shuffles(spark)
    by_right = neighbour_spans(suffixes, "right", reach, least, k)
    release_shuffles(spark)
    spans = by_right.unionByName(neighbour_spans(suffixes, "left", reach, least, k))
    return united(spans)


def neighbour_spans(suffixes: DataFrame, context: str, reach: int, least: int, k: int) -> DataFrame:
    """``doc_id, mark, start, end, other`` of the matches between neighbours in the order of (gram, ``context``, doc, pos)."""
    spark = suffixes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["gram", context, "doc_id", "pos"]
    ordered = suffixes.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    span = Rows(doc_id="long", mark="long", start="long", end="long", other="long", edge="long", gram="long", right="binary", left="binary")

    def columns(batch):
        grid = lambda c: np.frombuffer(b"".join(c.to_pylist()), ">u4").reshape(batch.num_rows, reach)
        return batch["gram"].to_numpy(), grid(batch["right"]), grid(batch["left"]), batch["doc_id"].to_numpy(), batch["pos"].to_numpy().astype(np.int64)

    def neighbours(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        first, last = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                now = batch.slice(at, CHUNK)
                now = pa.Table.from_batches([last, now] if last is not None else [now]).combine_chunks().to_batches()[0]
                first = now.slice(0, 1) if first is None else first
                key, right, left, doc, pos = columns(now)
                rows, *found = stretches(key, right, left, doc, pos, np.zeros(len(key), bool), least, k)
                n = len(rows)
                yield span.batch(doc[rows], now["mark"].to_numpy()[rows], *found, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()))
                last = now.slice(now.num_rows - 1, 1)
        for side, row in ((0, first), (1, last)):
            if row is not None:
                r = row.to_pylist()[0]
                yield span.batch([r["doc_id"]], [r["mark"]], [r["pos"]], [0], [0], [2 * part + side], [r["gram"]], [r["right"]], [r["left"]])

    with setting(spark, "spark.sql.execution.rangeExchange.sampleSizePerPartition", SAMPLED):
        found = materialise(ordered.mapInArrow(neighbours, span.schema), f"spans-{context}")
    edges = found.filter("edge IS NOT NULL").select("gram", "right", "left", "doc_id", "mark", F.col("start").cast("int").alias("pos"), "edge")
    edges = edges.repartition(1).sortWithinPartitions("edge")  # two rows a partition
    plain = Rows(doc_id="long", mark="long", start="long", end="long", other="long")

    def across(batches):
        last = None
        for batch in batches:
            now = pa.Table.from_batches([last, batch] if last is not None else [batch]).combine_chunks().to_batches()[0]
            key, right, left, doc, pos = columns(now)
            rows, *spans = stretches(key, right, left, doc, pos, now["edge"].to_numpy() % 2 == 1, least, k)
            yield plain.batch(doc[rows], now["mark"].to_numpy()[rows], *spans)
            last = now.slice(now.num_rows - 1, 1)

    return found.filter("edge IS NULL").select("doc_id", "mark", "start", "end", "other").unionByName(edges.mapInArrow(across, plain.schema))


def united(spans: DataFrame) -> DataFrame:
    """Overlapping or touching spans of a text as one, with the least other document."""
    rows = spans.groupBy("doc_id", "mark", "start").agg(F.max("end").alias("end"), F.min("other").alias("other"))
    of = W.partitionBy("doc_id", "mark")
    before = F.max("end").over(of.orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("fresh", F.coalesce(F.col("start") > before, F.lit(True)).cast("long"))
    rows = rows.withColumn("island", F.sum("fresh").over(of.orderBy("start").rowsBetween(W.unboundedPreceding, 0)))
    out = rows.groupBy("doc_id", "mark", "island").agg(F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("length"), F.min("other").alias("other_id"))
    return out.select("doc_id", "start", "length", "other_id")
