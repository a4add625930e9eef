"""Exact, cached use of ``tokenizers`` vocabularies.

A text is cut where the vocabulary's own pre-tokenizer must cut anyway (before
a single space that a visible character follows), and each piece is encoded by
the tokenizers library once per generation of a bounded cache. Pieces outside
the plain pattern (letters, then punctuation) go through the library's full
``encode``; texts that may hold a special token's string do so as a whole.
``encode_column`` looks a batch's distinct pieces up once each and gathers the
ids of all its texts from them.
"""

from __future__ import annotations

import re
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII marks other than the apostrophe, which begins contractions: a run of them is one piece.
PUNCT = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
SAFE_CUT = re.compile(r" (?=\S)")
#: The letters up to U+00FF, and the pattern of a plain piece.
LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha())
PLAIN = f"^[{LETTERS}]+[{''.join(chr(92) + c for c in PUNCT)}]*$"


def default_path(name: str) -> str:
    """Place of a public vocabulary file; import here keeps the path a parameter elsewhere."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    spare = iter(range(256, 512))
    return {b: table.get(b) or chr(next(spare)) for b in range(256)}


class _Cut(Exception):
    pass


class _Cache(dict):
    """Piece -> ids as little-endian unsigned 32-bit bytes.

    Two generations bound it: at ``most`` entries the young one becomes the old
    one, whose entries come back when they are met again.
    """

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


def _gather(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` in this order, one after another, and where each begins (one entry more)."""
    sizes = sizes[order]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    take = np.repeat(begins[order] - ends[:-1], sizes)
    take += np.arange(len(take))
    return flat[take], ends


def _runs(pool: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, pool), np.int64, len(pool)) // 4
    return np.frombuffer(b"".join(pool), "<u4"), np.cumsum(sizes) - sizes, sizes


class CachedTokenizer:
    """``encode(text)`` gives the ids of ``Tokenizer.encode(text, add_special_tokens=False)`` as bytes."""

    def __init__(self, path: str, most: int = 250_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tokenize = self.tok.model.tokenize
        self.lower = self.tok.normalizer is not None and "Lowercase" in str(self.tok.normalizer)
        alphabet = byte_letters()
        self.space = "" if self.lower else " "  # byte-level: a piece keeps the space before it
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.words = _Cache(self._word, most)
        self.segments = _Cache(self.segment, most)
        self.newline = b"" if self.lower else self.words["\n"]

    def full(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of one piece as the pre-tokenizer cuts it."""
        ids = [t.id for t in self.tokenize(word.encode().decode("latin1").translate(self.letters))]
        return pack(f"<{len(ids)}I", *ids)

    def _plain(self, part: str, lead: str) -> bytes | None:
        """Letters of the Latin blocks, then marks; None where the pattern does not hold."""
        core = part.rstrip(PUNCT)
        if not core.isalpha():
            return None
        if not core.isascii() and max(core) > "\u00ff":
            return None
        ids = self.words[lead + (core.lower() if self.lower else core)]
        return ids if len(core) == len(part) else ids + self.words[part[len(core) :]]

    def segment(self, seg: str) -> bytes:
        """A segment that a space precedes."""
        if not seg or seg[0].isspace():
            raise _Cut
        ids = self._plain(seg, self.space)
        if ids is not None:
            return ids
        if seg.count("\n") == 1 and seg[-1] != "\n":
            a, b = seg.split("\n")
            x, y = self._plain(a, self.space), self._plain(b, "")
            if x is not None and y is not None:
                return x + self.newline + y
        return self.full(" " + seg)

    def encode(self, text: str) -> bytes:
        if "<|" in text:
            return self.full(text)
        first, *rest = text.split(" ")
        try:
            return self.full(first) + b"".join(map(self.segments.__getitem__, rest))
        except _Cut:
            first, *rest = SAFE_CUT.split(text)
            return self.full(first) + b"".join([self.segments[s] if s.isalpha() else self.full(" " + s) for s in rest])

    def _halves(self, lead: str, units: pa.Array, pool: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``pool``, which grows, of each unit's letters and marks, and which units are plain.

        Entry 0 of the pool is empty; it stands for what a unit does not have.
        """
        plain = pc.match_substring_regex(units, PLAIN)
        units = pc.if_else(plain, units, "")
        core, out = pc.utf8_rtrim(units, characters=PUNCT), []
        for lead, part in ((lead, pc.utf8_lower(core) if self.lower else core), ("", pc.utf8_ltrim(units, characters=LETTERS))):
            coded = part.dictionary_encode()
            out.append(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + len(pool))
            get = self.words.__getitem__
            pool += [get(lead + w) if w else b"" for w in coded.dictionary.to_pylist()]
        return np.stack(out, 1), plain.to_numpy(zero_copy_only=False).astype(bool)

    def _distinct(self, words: pa.Array, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all these segments, where each begins, and which of them are none (a text is not cut there)."""
        lines = pc.and_(pc.equal(pc.count_substring(words, "\n"), 1), pc.invert(pc.ends_with(words, "\n")))
        two = lines.to_numpy(zero_copy_only=False).astype(bool)
        sides = pc.split_pattern(words.filter(lines), "\n").flatten()
        at = np.arange(0, len(sides), 2)
        pool = [b"", self.newline]
        order = np.zeros((len(words), 5), np.int64)
        order[:, :2], plain = self._halves(self.space, pc.replace_with_mask(words, lines, sides.take(pa.array(at))), pool)
        order[two, 2] = 1
        order[two, 3:], plain_end = self._halves("", sides.take(pa.array(at + 1)), pool)
        plain[two] &= plain_end
        cut = np.zeros(len(words), bool)
        for k in np.flatnonzero(~plain).tolist():
            w = words[k].as_py()
            cut[k] = not w or w[0].isspace()
            order[k] = 0
            if used[k] and not cut[k]:
                order[k, 0] = len(pool)
                pool.append(self.segments[w])
        ids, ends = _gather(*_runs(pool), order.ravel())
        return ids, ends[::5], cut

    def encode_column(self, col: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids begin (one entry more than texts).

        ``end_id`` closes each text. The texts must not be null.
        """
        n = len(col)
        split = pc.split_pattern(col, " ")
        first = np.asarray(split.offsets, np.int64)  # of each text's pieces
        coded = split.values.slice(int(first[0]), int(first[-1] - first[0])).dictionary_encode()
        first = first - first[0]
        pieces = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        heads, words = first[:-1], coded.dictionary
        inner = np.ones(len(pieces), bool)
        inner[heads] = False
        used = np.zeros(len(words), bool)
        used[pieces[inner]] = True
        ids, ends, cut = self._distinct(words, used)
        whole = pc.match_substring(col, "<|").to_numpy(zero_copy_only=False).astype(bool)
        stopped = np.concatenate([[0], np.cumsum(inner & cut[pieces])])
        whole |= stopped[first[1:]] > stopped[heads]
        pool = [self.encode(col[k].as_py()) if alone else self.full(words[p].as_py()) for k, (alone, p) in enumerate(zip(whole.tolist(), pieces[heads].tolist(), strict=True))]
        pieces[heads] = np.arange(len(words), len(words) + n)
        if whole.any():  # such a text's other pieces are in its head already
            counts = np.diff(first)
            pieces = pieces[~(np.repeat(whole, counts) & inner)]
            first = np.concatenate([[0], np.cumsum(np.where(whole, 1, counts))])
        if end_id is not None:
            pieces = np.insert(pieces, first[1:], len(words) + n)
            first = first + np.arange(n + 1)
            pool.append(pack("<I", end_id))
        flat, begins, sizes = _runs(pool)
        ids, ends = _gather(np.concatenate([ids, flat]), np.concatenate([ends[:-1], begins + len(ids)]), np.concatenate([np.diff(ends), sizes]), pieces)
        return ids, ends[first]


@lru_cache(maxsize=4)
def cached(path: str) -> CachedTokenizer:
    """One tokenizer per worker process and file."""
    return CachedTokenizer(path)
