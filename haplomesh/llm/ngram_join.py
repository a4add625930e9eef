"""N-gram Jaccard join by MinHash banding (operator 10).

Rows with one shingle set form a class. Each class has a signature of
``bands * rows`` minima; the two counts are chosen so that a pair at the
threshold meets in a band with the target recall. Classes are shuffled on their
band hashes. Every pair of classes that meet in a bucket is a candidate, and its
full n-gram sets are compared. So that neither sets nor pairs are copied for
each bucket, a class has one home, its largest bucket or where few share that
the largest home it meets, whose classes are dealt to blocks of bounded size; two blocks that meet in some bucket are compared in
one square tile, a block that has two classes or more in a tile with itself.
Each candidate pair lies in exactly one tile, chains of buckets never grow a
tile, and a tile gives counts and a forest of links, not pairs. ``n_links``
counts all other rows with similarity of at least the threshold, copies
included. Sets are of 64-bit hashes of the n-grams.

Odd input: null and empty texts, and texts without a word, have no n-grams:
each is a class of its own without links. Texts of fewer than ``n`` words have
one n-gram, the whole text. Rows of null ``doc_id`` stay, with null class and
group and no links; rows that repeat a ``doc_id`` are rows like others, each by
its own text (two with one text link to each other). Very long texts weigh in
the size of a block, which is bounded by n-grams too. An empty table gives no
rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, fresh, id_and_text, mark, materialise, small_batches, tidy
from .components import connected_components
from .shingles import grams, mixed, word_hashes, words

N, THRESHOLD, RECALL = 5, 0.8, 0.9995
SECOND = np.uint64(0x5851F42D4C957F2D)
TILE = 512  # classes of a block at most; the root of its home's classes where that is more
BLOCK_GRAMS = 1 << 21  # n-grams of a block, about


def band_plan(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = 6) -> tuple[int, int]:
    """(bands, rows): the fewest bands with which a pair at the threshold is met with the recall."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))), rows


class MinHash:
    """Band hashes of many shingle sets at once."""

    def __init__(self, bands: int, rows: int, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.mul = (rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
        self.add = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)

    def band_hashes(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Rows of ``bands`` signed 64-bit hashes; ``starts`` are the sets' first places in ``flat``."""
        low = (flat >> np.uint64(32)).astype(np.uint32)
        out = np.tile(np.arange(1, self.bands + 1, dtype=np.uint64), (len(starts), 1))  # so bands never meet each other
        work = np.empty_like(low)
        for k in range(self.bands * self.rows):
            np.multiply(low, self.mul[k], out=work)
            np.add(work, self.add[k], out=work)
            b = k // self.rows
            out[:, b] = mixed(out[:, b] + np.minimum.reduceat(work, starts).astype(np.uint64) + np.uint64(1))
        return out.view(np.int64)


def shingle_set(text: str, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams."""
    return np.unique(grams(word_hashes(words(text)), n))


def runs(batches, width: int):
    """(key, other values of its rows) for each run of rows with equal leading ``width`` columns."""
    key, rows_ = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:width] != key:
                if rows_:
                    yield key, rows_
                key, rows_ = row[:width], []
            rows_.append(row[width:])
    if rows_:
        yield key, rows_


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, mark, set_hi, set_lo, size, bands``: the text's hash, two words that identify the set, its size, its band hashes."""
    out = Rows(doc_id="long", mark="long", set_hi="long", set_lo="long", size="long", bands="array<long>")

    def run(batches):
        minhash = MinHash(bands, rows)
        for batch in small_batches(batches, 512 << 10):
            sets = [shingle_set(t, n) for t in batch.column(1).to_pylist()]
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            hashes = np.zeros((len(sets), bands), np.int64)
            high, low = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            if len(full):
                flat = np.concatenate([sets[k] for k in full])
                starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                hashes[full] = minhash.band_hashes(flat, starts)
                high[full] = np.add.reduceat(mixed(flat), starts)
                low[full] = np.add.reduceat(mixed(flat ^ SECOND), starts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(hashes.ravel()))
            yield out.batch(batch.column(0), batch.column(2), high.view(np.int64), low.view(np.int64), sizes, lists)

    return id_and_text(docs).withColumn("mark", mark(F.col("text"))).mapInArrow(tidy(run), out.schema)


def link_tile(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs whose Jaccard similarity reaches the threshold.

    ``right`` None: the tile is of ``left`` with itself (the diagonal is False).
    Only hashes of two or more sets can be shared; they are counted by matrix
    products over slices of them, so memory does not follow the texts' length.
    """
    sets = left if right is None else left + right
    size = np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), size.astype(np.int64))
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    n, m = len(left), len(sets) if right is None else len(right)
    common = np.zeros((n, m), np.float32)
    if len(column):
        column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1
        step = 4096
        cuts = np.searchsorted(column, np.arange(0, int(column[-1]) + 1 + step, step))
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            dense = np.zeros((len(sets), step), np.float32)
            dense[owner[a:b], column[a:b] % step] = 1
            common += dense[:n] @ (dense if right is None else dense[n:]).T
    both = size[:n, None] + (size if right is None else size[n:])[None, :] - common
    linked = common >= threshold * both - 1e-9
    if right is None:
        np.fill_diagonal(linked, False)
    return linked


def forest(linked: np.ndarray, square: bool) -> list[tuple[int, int]]:
    """Edges (row, column) that connect whatever the matrix connects."""
    n, m = linked.shape
    root = np.arange(n if square else n + m)
    out = []
    rows, cols = np.nonzero(np.triu(linked) if square else linked)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = int(root[x])
        return x

    if len(rows) > 4 * len(root):  # many links: label propagation first would cost more than a pruned scan
        keep = np.concatenate([[True], rows[1:] != rows[:-1]])
        first = list(zip(rows[keep].tolist(), cols[keep].tolist()))
        rest = zip(rows[~keep].tolist(), cols[~keep].tolist())
    else:
        first, rest = zip(rows.tolist(), cols.tolist()), ()
    for edges in (first, rest):
        for i, j in edges:
            a, b = find(i), find(j if square else n + j)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((i, j))
                if len(out) == len(root) - 1:
                    return out
    return out


def blocks_and_tiles(classes: DataFrame, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(node, block) of the classes that meet another in some band, and (block, x, y): the tiles that a block goes to.

    A home of fewer classes than half a block joins the largest home that it
    meets, one step and no chain, so the stragglers of a large group do not each
    make a block that all others meet. A home's classes are dealt by hash, so a
    home of m classes has m / tile blocks, or the root of m.
    """
    bands = classes.select("node", F.explode("bands").alias("hash"))
    sizes = materialise(bands.groupBy("hash").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "buckets")
    met = materialise(bands.join(sizes, "hash"), "met")
    homes = met.groupBy("node").agg(F.max(F.struct("m", "hash")).alias("s")).select("node", F.col("s.hash").alias("home"))
    homes = materialise(homes.join(classes.select("node", "size"), "node"), "homes")
    many = materialise(homes.groupBy("home").agg(F.count(F.lit(1)).alias("n")), "counts")
    places = met.select("hash", "node").join(homes.select("node", "home"), "node").select("hash", "home").distinct()
    places = materialise(places.join(many, "home"), "places")
    top = materialise(places.groupBy("hash").agg(F.max(F.struct("n", "home")).alias("top")), "top")
    hosts = places.filter(F.col("n") < tile // 2).join(top, "hash").groupBy("home").agg(F.max("top").alias("top"))
    hosts = materialise(hosts.select("home", F.col("top.home").alias("host")), "hosts")
    homes = homes.join(hosts, "home", "left").select("node", "size", F.coalesce("host", "home").alias("home"))
    homes = materialise(homes, "hosted")
    n, grams_ = F.count(F.lit(1)), F.sum("size")
    sides = F.greatest(F.ceil(n / F.greatest(F.lit(tile), F.sqrt(n))), F.ceil(grams_ / BLOCK_GRAMS)).cast("long")
    sides = materialise(homes.groupBy("home").agg(sides.alias("side")), "sides")
    blocks = homes.join(sides, "home").select("node", F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("side"))).alias("block"))
    blocks = materialise(blocks, "blocks")
    seen = materialise(met.select("hash", "node").join(blocks, "node").select("hash", "block").distinct(), "seen")
    several = seen.groupBy("hash").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("hash")
    shared = materialise(seen.join(several, "hash"), "shared")
    pairs = shared.select("hash", F.col("block").alias("x")).join(shared.select("hash", F.col("block").alias("y")), "hash").filter("x < y").select("x", "y").distinct()
    pairs = materialise(pairs, "tiles")
    own = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("block", F.col("block").alias("x"), F.col("block").alias("y"))
    return blocks, own.unionByName(pairs.select(F.explode(F.array("x", "y")).alias("block"), "x", "y"))


def single_texts(docs: DataFrame, base: DataFrame) -> DataFrame:
    """``doc_id, mark, text``; rows that repeat both id and text are one where there are any."""
    texts = id_and_text(docs).withColumn("mark", mark(F.col("text")))
    again = base.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return texts if again.isEmpty() else texts.dropDuplicates(["doc_id", "mark"])


def ngram_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """``doc_id, class_id, n_links, group_id`` for every document.

    ``class_id``: least ``doc_id`` with the same n-gram set; ``group_id``: least
    ``doc_id`` that chains of links reach; ``n_links``: linked rows.
    """
    bands, rows = band_plan(threshold, recall)
    base = materialise(signatures(docs, n, bands, rows), "signatures")
    shape = ["set_hi", "set_lo", "size"]
    known = base.filter("doc_id IS NOT NULL AND size > 0")
    classes = known.groupBy(*shape).agg(F.min(F.struct("doc_id", "mark")).alias("lead"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    # The number of a class is its own even where rows of other classes repeat its doc_id; the written table keeps it.
    classes = classes.select(F.monotonically_increasing_id().alias("node"), F.col("lead.doc_id").alias("class_id"), F.col("lead.mark").alias("lead_mark"), *shape, "copies", "bands")
    classes = materialise(classes, "classes")
    blocks, places = blocks_and_tiles(classes.select("node", "size", "bands"), tile)

    # One fetch of the texts of candidate classes only; their sets go to the tiles.
    wanted = classes.select("node", "class_id", "lead_mark", "copies").join(blocks, "node")
    texts = single_texts(docs, base).join(wanted, (F.col("doc_id") == F.col("class_id")) & (F.col("mark") == F.col("lead_mark")))
    sets = Rows(node="long", copies="long", block="long", grams="binary")

    def to_sets(batches):
        for batch in batches:
            for part in small_batches([batch]):
                node, copies, block, text = part.columns
                yield sets.batch(node, copies, block, [shingle_set(t, n).tobytes() for t in text.to_pylist()])

    members = materialise(texts.select("node", "copies", "block", "text").mapInArrow(tidy(to_sets), sets.schema), "sets")
    tiles = members.join(places, "block").select("x", "y", "block", "node", "copies", "grams")
    found = Rows(node="long", other="long", weight="long")

    def verify(batches):
        for (x, y), rows_ in runs(batches, 2):
            part = {x: ([], [], []), y: ([], [], [])}
            for blk, node, w, g in rows_:
                ids, ws, gs = part[blk]
                ids.append(node), ws.append(w), gs.append(np.frombuffer(g, np.uint64))
            (ids, ws, gs), other = part[x], part[y]
            if x == y:
                linked = link_tile(gs, None, threshold)
                out = [(ids[i], ids[j], 0) for i, j in forest(linked, True)]
                gain = linked @ np.asarray(ws, np.int64)
                out += [(c, c, int(v)) for c, v in zip(ids, gain) if v]
            else:
                linked = link_tile(gs, other[2], threshold)
                out = [(ids[i], other[0][j], 0) for i, j in forest(linked, False)]
                out += [(c, c, int(v)) for c, v in zip(ids, linked @ np.asarray(other[1], np.int64)) if v]
                out += [(c, c, int(v)) for c, v in zip(other[0], linked.T @ np.asarray(ws, np.int64)) if v]
            if out:
                yield found.batch(*zip(*out))

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiles.repartition(parts, "x", "y").sortWithinPartitions("x", "y")
    links = materialise(dealt.mapInArrow(tidy(verify), found.schema), "links")
    chains = materialise(connected_components(links.filter("node <> other"), "node", "other"), "chains")
    names = classes.select("node", "class_id")
    groups = chains.join(names, "node").groupBy("component").agg(F.min("class_id").alias("group_id"))
    chains = chains.join(materialise(groups, "groups"), "component").select("node", "group_id")
    gains = links.filter("node = other").groupBy("node").agg(F.sum("weight").alias("gain"))
    classes = classes.join(gains, "node", "left").join(chains, "node", "left")
    classes = classes.select(*shape, "class_id", (F.col("copies") - 1 + F.coalesce("gain", F.lit(0))).alias("n_links"), F.coalesce("group_id", "class_id").alias("group_id"))
    classes = materialise(classes, "linked")
    out = base.withColumn("own", F.col("doc_id").isNotNull()).join(classes.withColumn("own", F.lit(True)), [*shape, "own"], "left")
    return out.select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("group_id", "doc_id").alias("group_id"),
    )


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of ``docs`` for each group of the join: that of the smallest id (null ids last); all its columns.

    The rows are numbered in a written table first, so null and repeated ids
    are rows of their own. Rows without n-grams (empty texts) all stay.
    """
    names = docs.columns
    key = fresh("_row", names)
    numbered = materialise(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    own = numbered.select(F.col(key).alias("doc_id"), F.col(text_col).alias("text"))
    found = materialise(ngram_join(own), "joined").select(F.col("doc_id").alias(key), F.col("group_id").alias("of"), "n_links")
    linked = found.filter("n_links > 0").join(numbered.select(key, F.col(id_col).cast("long").alias("id")), key)
    first = linked.groupBy("of").agg(F.min(F.struct(F.col("id").isNull().alias("absent"), "id", F.col(key).alias("row"))).alias("s")).select(F.col("s.row").alias(key))
    goes = materialise(linked.select(key).join(first, key, "left_anti"), "dropped")
    return numbered.join(goes, key, "left_anti").select(*names)
