"""Byte-level BPE over padded numpy matrices (operator 4).

Distinct pre-tokens of a batch are bucketed by length into padded matrices of
ranks. In each round every row looks the ranks of its adjacent pairs up in an
open-addressing hash table, merges its leftmost pair of least rank, and is
compacted; rows without a mergeable pair leave the matrix. Long pre-tokens form
buckets of few rows, so a matrix stays within a fixed number of cells.

Odd input: null and empty texts give no ids; any bytes round-trip, since all 256
single bytes have ranks; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import Rows, id_and_text, small_batches

CELLS = 1 << 20  # of a padded matrix
NONE = np.int32(np.iinfo(np.int32).max)


class PairTable:
    """(left id, right id) -> merged id, by linear probing over a power-of-two table."""

    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pairs: np.ndarray, merged: np.ndarray):
        bits = max(4, int(len(pairs) * 2.5).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NONE, np.int32)
        todo = np.arange(len(pairs))
        slot = self._slot(pairs)
        while len(todo):
            at = slot[todo]
            free = self.keys[at] == -1
            self.keys[at[free]] = pairs[todo[free]]  # of those that meet here, the last one stays
            won = self.keys[at] == pairs[todo]
            self.values[at[won]] = merged[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & self.mask
        probes, slot = 1, self._slot(pairs)
        while (miss := self.keys[slot] != pairs).any():
            slot[miss] = (slot[miss] + 1) & self.mask
            probes += 1
        self.probes = probes

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * self.MIX) >> self.shift).astype(np.int64)

    def get(self, pairs: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where a pair has none."""
        slot = self._slot(pairs)
        keys = self.keys[slot]
        out = np.where(keys == pairs, self.values[slot], NONE)
        open_ = np.flatnonzero((keys != pairs) & (keys != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            at = (slot[open_] + 1) & self.mask
            slot[open_] = at
            keys = self.keys[at]
            hit = keys == pairs[open_]
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (keys != -1)]
        return out


class ByteBPE:
    """Encoder and decoder by a tiktoken rank file and a pre-token pattern."""

    def __init__(self, path: str, pattern: str, most: int = 250_000):
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs, merged = [], []
        for token, rank in ranks.items():  # every cut of a token into two tokens can merge to it
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs.append(a << 32 | b)
                    merged.append(rank)
        self.table = PairTable(np.array(pairs, np.int64), np.array(merged, np.int32))
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.cut = regex.compile(r" (?=\S)").split
        self.most = most
        self.known: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    # -- pre-tokens ---------------------------------------------------------
    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece; pieces that are tokens themselves still go through the merges."""
        out: list = [None] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(sizes, kind="stable")
        at = int(np.searchsorted(sizes[order], 1))
        for k in order[:at]:
            out[k] = np.empty(0, np.int32)
        while at < len(order):
            width = int(sizes[order[at]])
            top = max(width + 2, width * 9 // 8)  # a bucket's lengths differ by an eighth at most
            end = int(np.searchsorted(sizes[order], top, side="right"))
            end = min(end, at + max(1, CELLS // top))
            rows = order[at:end]
            self._merge([pieces[k] for k in rows], sizes[rows], rows, out)
            at = end
        return out

    def _merge(self, pieces: list[bytes], sizes: np.ndarray, rows: np.ndarray, out: list) -> None:
        width = int(sizes.max())
        flat = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        cols = np.arange(width)
        grid = np.full((len(pieces), width), -1, np.int32)
        grid[cols < sizes[:, None]] = flat
        lengths = sizes.copy()
        rank = np.full((len(pieces), width), NONE, np.int32)  # rank[i, j] of the pair (j, j + 1)
        pair = (cols + 1) < lengths[:, None]
        pair[:, -1] = False
        r, c = np.nonzero(pair)
        rank[r, c] = self.table.get(grid[r, c].astype(np.int64) << 32 | grid[r, c + 1])
        while True:
            best = rank.argmin(1)  # the leftmost pair of least rank
            value = rank[np.arange(len(rank)), best]
            done = value == NONE
            if done.any():
                for k in np.flatnonzero(done):
                    out[rows[k]] = grid[k, : lengths[k]].copy()
                go = ~done
                if not go.any():
                    return
                grid, rank, lengths, rows, best, value = grid[go], rank[go], lengths[go], rows[go], best[go], value[go]
                width = int(lengths.max())
                grid, rank = grid[:, :width], rank[:, :width]
            n = np.arange(len(grid))
            grid[n, best] = value
            if width <= 64:
                take = np.arange(width)[None, :] + (np.arange(width)[None, :] > best[:, None])
                take = np.minimum(take, width - 1)
                last = lengths - 1
                grid = np.take_along_axis(grid, take, 1)
                rank = np.take_along_axis(rank, take, 1)
                grid[n, last], rank[n, last] = -1, NONE
            else:
                for i, b in enumerate(best.tolist()):
                    grid[i, b + 1 : -1] = grid[i, b + 2 :]
                    rank[i, b + 1 : -1] = rank[i, b + 2 :]
                grid[n, lengths - 1], rank[n, lengths - 1] = -1, NONE
            lengths = lengths - 1
            rank[n, np.maximum(lengths - 1, 0)] = NONE
            for at in (best, best - 1):  # the two pairs beside the merged id
                ok = (at >= 0) & (at + 1 < lengths)
                i, j = n[ok], at[ok]
                rank[i, j] = self.table.get(grid[i, j].astype(np.int64) << 32 | grid[i, j + 1])
                if at is best:
                    rank[n[~ok], at[~ok]] = NONE

    # -- texts --------------------------------------------------------------
    def segments(self, text: str) -> list[str]:
        """Cut before a single space that a visible character follows, where the pattern must cut too."""
        first, *rest = text.split(" ")
        if any(not s or s[0].isspace() for s in rest):
            first, *rest = self.cut(text)
        return [first, *[" " + s for s in rest]]

    def learn(self, segs: set[str]) -> None:
        """Encode the segments that the cache lacks, all their pre-tokens in one call."""
        new = []
        for s in segs:
            if s not in self.known:
                if (kept := self.old.get(s)) is not None:
                    self.known[s] = kept
                else:
                    new.append(s)
        found = [self.find(s) for s in new]
        unique = list(dict.fromkeys(p for f in found for p in f))
        ids = dict(zip(unique, self.encode_pieces([p.encode() for p in unique]), strict=True))
        for s, f in zip(new, found, strict=True):
            self.known[s] = ids[f[0]].tobytes() if len(f) == 1 else b"".join([ids[p].tobytes() for p in f])

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """int32 ids of each text."""
        if len(self.known) >= self.most:
            self.old, self.known = self.known, {}
        cut = [self.segments(t) for t in texts]
        self.learn({s for c in cut for s in c})
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, c)), np.int32) for c in cut]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist() if hasattr(ids, "tolist") else ids))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> ByteBPE:
    """One encoder per worker process, rank file and pattern."""
    return ByteBPE(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` (array of int) of each document's whole text."""
    rows = Rows(doc_id="long", ids="array<int>")

    def run(batches):
        import pyarrow as pa

        bpe = encoder(path, pattern)
        for batch in small_batches(batches, 4 << 20):
            ids = bpe.encode_batch(batch.column(1).to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield rows.batch(batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)))

    return id_and_text(docs).mapInArrow(run, rows.schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, decoded`` (bytes) of the ids of :func:`encode_documents`; null ids decode to no bytes."""
    rows = Rows(doc_id="long", decoded="binary")

    def run(batches):
        bpe = encoder(path, pattern)
        for batch in batches:
            yield rows.batch(batch.column(0), [bpe.decode(x or []) for x in batch.column(1).to_pylist()])

    return encoded.select("doc_id", "ids").mapInArrow(run, rows.schema)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, decode and digest in one pass: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    from hashlib import sha256

    rows = Rows(doc_id="long", n_tokens="long", ids_sha256="string", decoded_sha256="string")

    def run(batches):
        bpe = encoder(path, pattern)
        for batch in small_batches(batches, 4 << 20):
            lengths, coded, decoded = [], [], []
            for ids in bpe.encode_batch(batch.column(1).to_pylist()):
                plain = ids.tolist()
                lengths.append(len(plain))
                coded.append(sha256(str(plain)[1:-1].replace(" ", "").encode()).hexdigest())
                decoded.append(sha256(bpe.decode(plain)).hexdigest())
            yield rows.batch(batch.column(0), lengths, coded, decoded)

    return id_and_text(docs).mapInArrow(run, rows.schema)
