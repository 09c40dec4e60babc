"""Word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MULTIPLIERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
CACHE_WORDS = 200_000
LONGEST_CACHED = 48


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        got = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST_CACHED:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = got
        return got


_words = WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode().translate(_LOWER).split() if text else []


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The distinct n-word shingles' hashes, ascending; a text of fewer words is one shingle, an empty one has none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(n, len(w))
    h = np.full(len(w) - size + 1, np.uint64(size))
    for i in range(size):
        h += w[i : len(w) - size + 1 + i] * _MULTIPLIERS[i]
    return np.unique(_mixed(h))
