"""Words of UTF-8 texts and 64-bit hashes of words and word n-grams, one text at a time."""

from __future__ import annotations

import numpy as np
import xxhash

#: ``bytes.split()`` cuts at exactly space and \\x09-\\x0D, and ``bytes.lower()`` touches A-Z only.
SPACES = b" \t\n\x0b\x0c\r"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def hash_ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """One order-sensitive hash for each run of ``n`` words; empty if the text is shorter."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    mixed = hashes[:count].copy()
    for k in range(1, n):
        mixed ^= mixed >> _SHIFT
        mixed *= _MIX
        mixed += hashes[k : k + count]
    mixed ^= mixed >> _SHIFT
    mixed *= _MIX
    mixed ^= mixed >> _SHIFT
    return mixed
