"""Words, word hashes and shingle sets, shared by the near-duplicate operators.

Words are the maximal runs of letters, digits and underscores of the lower-cased text.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"\w+").findall
MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    """Word -> 64-bit hash; emptied at a bound, which costs only time."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


HASHES = _Hashes()


def words(text: str) -> list[str]:
    return WORD(text.lower())


def word_hashes(tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, tokens), np.uint64, len(tokens))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every bit depends on all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * MULTIPLIER
    h = h ^ (h >> np.uint64(29))
    h = h * MULTIPLIER
    return h ^ (h >> np.uint64(32))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` word hashes; of the whole text where it has fewer words."""
    if len(h) == 0:
        return h
    k = min(k, len(h))
    n = len(h) - k + 1
    out = h[:n].copy()
    for i in range(1, k):
        out = out * MULTIPLIER + h[i : i + n]
    return mixed(out)
