"""Word shingles of whole texts as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; forgets them all when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Distinct shingles of ``size`` words; A-Z count as a-z, words are parted by ASCII white space.

    A text of fewer words, but not none, is one shingle: the whole sequence.  Null and blank texts have none.
    """

    def __init__(self, size: int):
        self.size, self.hashes = size, WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
        n = len(words)
        if not n:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, n)
        size = min(self.size, n)
        with np.errstate(over="ignore"):
            # The number of words starts the chain, so that a short text equals no shingle of another length.
            total = np.full(n - size + 1, size, np.uint64)
            for k in range(size):
                total = mix(total + h[k:n - size + 1 + k])
        total.sort()
        keep = np.ones(len(total), bool)
        keep[1:] = total[1:] != total[:-1]
        return total[keep]
