"""Vector bin packing of token sequences (operator 6).

An example is a vector of tokens, segments and loss-bearing tokens. Sequences
are bins with a limit on each. Within a bounded window of waiting pieces a bin
takes, again and again, the piece that fits and has the largest dot product
with the bin's remaining room (each dimension as a share of its limit). What no
piece fills whole is filled by cutting one, so that a bin is full unless its
segment or loss limit stops it. Pieces that are left at the end of a partition
go to bins whose lengths are powers of two, which need no padding.

Packing is local to a partition of the input and needs no shuffle; memory is
bounded by the window. Odd input: null and empty texts are documents of the end
id alone; repeated ``doc_id`` values are packed each by itself; null ``doc_id``
stays null; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, id_and_text_columns, small_batches, tidy
from .vocabulary import cached

BATCH = 2 << 20  # bytes of text that are encoded at once
COLUMNS = {"doc_id": "long", "start": "long", "length": "long", "ids_crc32": "long", "doc_tokens": "long", "sequence_id": "long", "offset": "long", "loss_tokens": "long"}


@dataclass
class Piece:
    doc: int | None
    start: int
    ids: bytes  # little-endian unsigned 32-bit
    total: int
    mask: bytes | None = None  # a byte for each id, 1 where it bears loss; None: all do

    def __len__(self) -> int:
        return len(self.ids) // 4

    def loss(self) -> int:
        return len(self) if self.mask is None else self.mask.count(1)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        m = self.mask
        return (
            Piece(self.doc, self.start, self.ids[: 4 * n], self.total, m and m[:n]),
            Piece(self.doc, self.start + n, self.ids[4 * n :], self.total, m and m[n:]),
        )


class Packer:
    """Bins of ``tokens`` ids, ``segments`` pieces and ``loss`` loss-bearing ids at most."""

    def __init__(self, tokens: int = 2048, segments: int = 64, loss: int | None = None, window: int = 1024, first_id: int = 0):
        self.limit = np.array([tokens, segments, tokens if loss is None else loss], np.float64)
        self.tokens, self.segments, self.window = tokens, segments, window
        self.loss_limit = int(self.limit[2])
        self.waiting: list[Piece] = []
        self.held = 0
        self.next_id = first_id

    def _emit(self, pieces: list[Piece]):
        at, sid = 0, self.next_id
        self.next_id += 1
        for p in pieces:
            yield (p.doc, p.start, len(p), zlib.crc32(p.ids), p.total, sid, at, p.loss())
            at += len(p)

    def add(self, piece: Piece):
        """Rows of the sequences that are complete after this example came."""
        while len(piece) >= self.tokens and (self.loss_limit >= self.tokens or piece.mask is not None and self._room(piece, self.tokens, self.loss_limit) == self.tokens):
            head, piece = piece.cut(self.tokens)
            yield from self._emit([head])
        if not len(piece):
            return
        while len(piece) > self.tokens or piece.loss() > self.loss_limit:
            head, piece = piece.cut(self._room(piece, self.tokens, self.loss_limit))
            self.waiting.append(head)
            self.held += len(head)
        self.waiting.append(piece)
        self.held += len(piece)
        if len(self.waiting) >= self.window:
            yield from self._fill(keep=self.window // 2)

    @staticmethod
    def _room(p: Piece, tokens: int, loss: int) -> int:
        """How many leading ids of ``p`` fit into so many tokens and loss tokens."""
        n = min(len(p), tokens)
        if p.mask is None:
            return min(n, loss)
        bearing = np.flatnonzero(np.frombuffer(p.mask, np.uint8)[:n])
        return n if len(bearing) <= loss else int(bearing[loss])

    def _vectors(self) -> np.ndarray:
        return np.array([(len(p), 1, p.loss()) for p in self.waiting], np.float64)

    def _fill(self, keep: int):
        """Close bins while more than ``keep`` pieces wait and they hold a full bin."""
        vec = self._vectors()
        alive = np.ones(len(vec), bool)
        pieces = list(self.waiting)
        left = len(pieces)
        while left > keep and self.held >= self.tokens:
            room, chosen = self.limit.copy(), []
            while room[0] > 0 and room[1] > 0 and room[2] > 0:
                fits = alive & (vec <= room).all(1)
                if fits.any():
                    score = np.where(fits, (vec / self.limit) @ (room / self.limit), -1.0)
                    k = int(score.argmax())
                    piece = pieces[k]
                    alive[k] = False
                    left -= 1
                elif alive.any():  # cut the longest waiting piece to the room that is left
                    k = int(np.where(alive, vec[:, 0], -1.0).argmax())
                    n = self._room(pieces[k], int(room[0]), int(room[2]))
                    if not n:
                        break
                    piece, pieces[k] = pieces[k].cut(n)
                    vec[k] = len(pieces[k]), 1, pieces[k].loss()
                else:
                    break
                chosen.append(piece)
                self.held -= len(piece)
                room -= (len(piece), 1, piece.loss())
            yield from self._emit(chosen)
        self.waiting = [p for p, a in zip(pieces, alive, strict=True) if a]

    def finish(self):
        """Full bins first, then bins whose lengths are powers of two."""
        yield from self._fill(keep=0)
        queue = self.waiting[::-1]
        self.waiting = []
        while queue:
            n = loss = tokens = 0
            for p in reversed(queue[-self.segments :]):
                take = self._room(p, self.tokens - tokens, self.loss_limit - loss)
                tokens, n = tokens + take, n + 1
                loss += p.cut(take)[0].loss()
                if take < len(p):
                    break
            size = 1 << (tokens.bit_length() - 1)
            chosen = []
            while size:
                p = queue.pop()
                if len(p) > size:
                    p, rest = p.cut(size)
                    queue.append(rest)
                chosen.append(p)
                self.held -= len(p)
                size -= len(p)
            yield from self._emit(chosen)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, tokens: int = 2048, segments: int = 64, loss: int | None = None, window: int = 1024, loss_col: str | None = None) -> DataFrame:
    """One row per piece: its document, place, checksum and sequence.

    ``loss_col`` names a boolean column: the ids of rows where it is true or null
    bear loss (a turn of the assistant, for instance), others none; without it all
    do. ``sequence_id`` holds the partition in its upper bits and a counter below.
    """
    rows = Rows(**COLUMNS)
    bears = F.lit(True) if loss_col is None else F.coalesce(F.col(loss_col).cast("boolean"), F.lit(True))
    rows_in = docs.select(*id_and_text_columns(), bears.alias("bears"))

    def pack(batches):
        from pyspark import TaskContext

        tok = cached(vocabulary)
        packer = Packer(tokens, segments, loss, window, TaskContext.get().partitionId() << 40)
        for batch in small_batches(batches, BATCH):
            out = []
            found, first = tok.encode_column(batch.column(1), end_id)
            data, at = found.tobytes(), (4 * first).tolist()
            for doc_id, bears_loss, a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), at, at[1:], strict=False):
                n = (b - a) // 4
                out.extend(packer.add(Piece(doc_id, 0, data[a:b], n, None if bears_loss else bytes(n))))
            if out:
                yield rows.batch(*zip(*out))
        if out := list(packer.finish()):
            yield rows.batch(*zip(*out))

    return rows_in.mapInArrow(tidy(pack), rows.schema)
