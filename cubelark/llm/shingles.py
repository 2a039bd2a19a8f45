"""Word shingles as 64-bit hashes, for many texts at once."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Words of a shingle.
WORDS = 5
#: A word, after lower-casing: letters and digits.
WORD = re.compile(r"[^\W_]+")
#: Word hashes that a worker keeps; a full store starts anew.
CACHE_ENTRIES = 300_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_HASHES = _Hashes()


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads hashes over all 64 bits."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' shingles in a row, and the offset of each text's first one (one more at the end).

    A text of fewer than WORDS words has one shingle of all its words; one
    without words has none.
    """
    lists = [WORD.findall(t.lower()) for t in texts]
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    words = np.fromiter((h for x in lists for h in map(_HASHES.__getitem__, x)), dtype=np.uint64, count=int(sizes.sum()))
    counts = np.where(sizes >= WORDS, sizes - WORDS + 1, np.minimum(sizes, 1))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    firsts = np.repeat(np.cumsum(sizes) - sizes - offsets[:-1], counts) + np.arange(offsets[-1])
    out = np.zeros(offsets[-1], dtype=np.uint64)
    with np.errstate(over="ignore"):
        last = np.repeat(np.cumsum(sizes), counts)
        for k in range(WORDS):
            here = firsts + k
            inside = here < last
            out = out * _STEP + np.where(inside, words[np.minimum(here, max(len(words) - 1, 0))], np.uint64(0)) if len(words) else out
    return mixed(out), offsets


def multipliers(n: int, seed: int) -> np.ndarray:
    """Odd 64-bit factors for as many hash functions."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * _STEP + np.uint64(seed)) | np.uint64(1)
