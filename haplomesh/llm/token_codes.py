"""Token-id output as directly addressable codes (operator 3).

A file holds the ids of a run of documents in ascending ``doc_id`` order. Each
id is cut into chunks, lowest first; level ``k`` stores the k-th chunk of every
id that has one, a continuation bitmap that tells which ids go on to the next
level, and a rank directory of the ones before each block of the bitmap. Any
token is then read with one rank per level and without decoding its
neighbours.

Odd input: null and empty texts hold the end id alone; null ``doc_id`` values
come first in the order; repeated ``doc_id`` values lie next to each other; an
empty table writes no file and reads back as no rows; ids over the widest level
raise ValueError.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import Rows, id_and_text, new_folder, small_batches
from .vocabulary import cached

MAGIC = b"HMDAC001"
BLOCK = 512  # bits a rank directory entry spans
WIDTHS = (8, 8, 16)  # bits of each level's chunk


def dac_encode(ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]:
    """Levels of (chunks, continuation bitmap, rank directory); the last level used has neither map."""
    rest = np.asarray(ids, np.uint64)
    if len(rest) and int(rest.max()) >> sum(widths):
        raise ValueError("an id is wider than all levels together")
    levels = []
    for k, width in enumerate(widths):
        kind = np.uint8 if width <= 8 else np.uint16 if width <= 16 else np.uint32
        chunk = (rest & np.uint64((1 << width) - 1)).astype(kind)
        rest = rest >> np.uint64(width)
        more = rest > 0
        if k == len(widths) - 1 or not more.any():
            levels.append((chunk, None, None))
            break
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        ones = np.bitwise_count(bits).reshape(-1, BLOCK // 8).sum(1, dtype=np.uint64)
        ranks = np.concatenate([[np.uint64(0)], np.cumsum(ones, dtype=np.uint64)])
        levels.append((chunk, bits, ranks))
        rest = rest[more]
    return levels


class DacFile:
    """Random access to one file's ids, documents and offsets."""

    def __init__(self, data: bytes | memoryview):
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a token code file")
        size = int.from_bytes(view[8:12], "little")
        head = json.loads(bytes(view[12 : 12 + size]))
        self.n_docs, self.n_tokens, self.widths = head["n_docs"], head["n_tokens"], head["widths"]
        arrays = [np.frombuffer(view, np.dtype(kind), count, at) for kind, count, at in head["arrays"]]
        self.doc_ids, self.has_id, self.starts = arrays[:3]
        self.levels, at = [], 3
        while at < len(arrays):
            deep = len(self.levels) + 1 < head["depth"]
            self.levels.append((arrays[at], arrays[at + 1] if deep else None, arrays[at + 2] if deep else None))
            at += 3 if deep else 1

    def token(self, i: int) -> int:
        """The i-th id of the file: one chunk and one rank per level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        out = shift = 0
        for (chunk, bits, ranks), width in zip(self.levels, self.widths):
            out |= int(chunk[i]) << shift
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            i, shift = self._rank(bits, ranks, i), shift + width
        return out

    @staticmethod
    def _rank(bits, ranks, i: int) -> int:
        block = i // BLOCK
        lo = block * (BLOCK // 8)
        whole = int(np.bitwise_count(bits[lo : i >> 3]).sum()) if i >> 3 > lo else 0
        return int(ranks[block]) + whole + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()

    def tokens(self, a: int, b: int) -> np.ndarray:
        """Ids a..b-1, from each level's own slice."""
        return self._slice(0, a, b).astype("<u4")

    def _slice(self, level: int, a: int, b: int) -> np.ndarray:
        chunk, bits, ranks = self.levels[level]
        out = chunk[a:b].astype(np.uint32)
        if bits is None or a >= b:
            return out
        more = np.unpackbits(bits[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 :][: b - a].astype(bool)
        ones = int(more.sum())
        if ones:
            lo = self._rank(bits, ranks, a)
            out[more] |= self._slice(level + 1, lo, lo + ones) << np.uint32(self.widths[level])
        return out


def dac_file(doc_ids: list, starts: np.ndarray, ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> bytes:
    """File bytes: magic, header length, JSON header with the place of each array, 8-byte aligned arrays."""
    arrays = [np.asarray([0 if d is None else d for d in doc_ids], "<i8"), np.asarray([d is not None for d in doc_ids], np.uint8), np.asarray(starts, "<u8")]
    levels = dac_encode(ids, widths)
    for level in levels:
        arrays += [x for x in level if x is not None]
    arrays = [np.ascontiguousarray(a).astype(a.dtype.newbyteorder("<"), copy=False) for a in arrays]
    size = 0
    while True:  # the header holds offsets that depend on its own length
        places, at = [], 12 + size
        for a in arrays:
            at += -at % 8
            places.append([a.dtype.str, len(a), at])
            at += a.nbytes
        head = json.dumps({"n_docs": len(doc_ids), "n_tokens": len(ids), "widths": list(widths), "depth": len(levels), "arrays": places}).encode()
        if len(head) <= size:
            head = head.ljust(size)
            break
        size = len(head)
    out = bytearray(MAGIC + size.to_bytes(4, "little") + head)
    for a, (_, _, at) in zip(arrays, places, strict=True):
        out += b"\0" * (at - len(out)) + a.tobytes()
    return bytes(out)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, file_tokens: int = 1 << 23) -> list[dict]:
    """Encode ``docs`` into files below ``path`` in ascending ``doc_id`` order.

    The texts are range-partitioned by ``doc_id``, so each task encodes and
    writes its own run; a file is closed at ``file_tokens`` ids. The names
    depend on the partition only and files are moved into place when whole, so
    a task that runs again leaves the same files. Returns (and writes as
    manifest.json) one entry per file with the ids before it.
    """
    rows = Rows(part="long", file="string", n_docs="long", n_tokens="long")

    def write(batches):
        from pyspark import TaskContext

        ctx = TaskContext.get()
        store, base = pafs.FileSystem.from_uri(path)
        tok = cached(vocabulary)
        doc_ids, lengths, parts, held, seq = [], [], [], 0, 0

        def flush():
            starts = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
            data = dac_file(doc_ids, starts, np.concatenate(parts))
            name = f"{base}/part-{ctx.partitionId():06d}-{seq:04d}.dac"
            temp = f"{name}.{ctx.taskAttemptId()}.tmp"
            with store.open_output_stream(temp) as out:
                out.write(data)
            store.move(temp, name)
            return rows.batch([ctx.partitionId()], [name.rpartition("/")[2]], [len(doc_ids)], [int(starts[-1])])

        for batch in small_batches(batches):
            ids, first = tok.encode_column(batch.column(1), end_id)
            batch_ids, lo = batch.column(0).to_pylist(), 0
            while lo < batch.num_rows:  # up to the text that fills the file
                hi = min(int(np.searchsorted(first, first[lo] + file_tokens - held)), batch.num_rows)
                doc_ids += batch_ids[lo:hi]
                lengths.append(np.diff(first[lo : hi + 1]))
                parts.append(ids[first[lo] : first[hi]])
                held += int(first[hi] - first[lo])
                if held >= file_tokens:
                    yield flush()
                    doc_ids, lengths, parts, held, seq = [], [], [], 0, seq + 1
                lo = hi
        if doc_ids:
            yield flush()

    store, base = pafs.FileSystem.from_uri(path)
    store.create_dir(base, recursive=True)
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = id_and_text(docs).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    found = sorted(ordered.mapInArrow(write, rows.schema).collect(), key=lambda r: (r.part, r.file))
    entries, before = [], 0
    for r in found:
        entries.append({"file": r.file, "n_docs": r.n_docs, "n_tokens": r.n_tokens, "start": before})
        before += r.n_tokens
    with store.open_output_stream(f"{base}/manifest.json") as out:
        out.write(json.dumps({"vocabulary": vocabulary.rpartition("/")[2], "end_id": end_id, "files": entries}).encode())
    return entries


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document of the files below ``path``, read from the files alone.

    ``doc_id, start, n_tokens, ids_crc32`` and, with ``with_ids``, ``ids``.
    """
    rows = Rows(doc_id="long", start="long", n_tokens="long", ids_crc32="long", **({"ids": "array<long>"} if with_ids else {}))

    def read(batches):
        store, base = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{base}/{name}") as src:
                    f = DacFile(src.read_buffer())
                starts = f.starts.astype(np.int64)
                lo = 0
                while lo < f.n_docs:  # blocks of about a million ids
                    hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + (1 << 20), side="right")) - 1)
                    ids = f.tokens(int(starts[lo]), int(starts[hi]))
                    view = memoryview(ids).cast("B")
                    at = (starts[lo : hi + 1] - starts[lo]).tolist()
                    crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at, at[1:])]
                    out = [pa.array(f.doc_ids[lo:hi], pa.int64(), mask=f.has_id[lo:hi] == 0), starts[lo:hi] + before, np.diff(starts[lo : hi + 1]), crc]
                    if with_ids:
                        out.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int64))))
                    yield rows.batch(*out)
                    lo = hi

    store, base = pafs.FileSystem.from_uri(path)
    with store.open_input_file(f"{base}/manifest.json") as src:
        files = json.loads(src.read())["files"]
    kind = T.StructType([T.StructField("file", T.StringType()), T.StructField("start", T.LongType())])
    entries = spark.createDataFrame([(f["file"], f["start"]) for f in files], kind)
    return entries.repartition(max(1, len(files))).mapInArrow(read, rows.schema)


def tokens_to_files(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Write the files in the shared folder and read them back."""
    path = new_folder(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary, end_id)
    return read_tokens(docs.sparkSession, path)
