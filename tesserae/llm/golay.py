"""The binary Golay code [23, 12, 7] for fuzzy hashing.

Every 23-bit word is within 3 bits of exactly one codeword. keys(x) are the codewords within 4 bits of x: one for words
within 2 bits of their codeword, six for the others. Two words that differ in at most 2 bits share a key: a word z
halfway differs from each in at most 1 bit, and z's codeword is within 3 of z, so within 4 of both.

For words that differ in at most 1 bit fewer keys do. They are equal or of different parity, so it is enough that odd
words take all their keys and even words only their nearest codeword: it is within 3 of the even word, so within 4 of
the odd one.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 (fixed value).
GENERATOR = 0b101011100011


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator."""
    r = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        r ^= np.where(r >> bit & 1, GENERATOR << (bit - 11), 0)
    return r


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each syndrome: error patterns of weight 4 at most (six places, the lightest first), how many, and for each
    low byte triple nothing else is needed: the syndrome itself is linear, so it is looked up by 12 + 11 bits."""
    errors = np.zeros((2048, 6), np.int64)
    counts = np.zeros(2048, np.int64)
    for weight in range(5):
        patterns = np.array([sum(1 << b for b in c) for c in combinations(range(23), weight)], np.int64)
        for s, e in zip(syndrome(patterns), patterns, strict=True):
            # within 2 bits of a codeword, no other one is within 4
            if weight <= 3 or counts[s] >= 1 and errors[s, 0].bit_count() == 3:
                errors[s, counts[s]] = e
                counts[s] += 1
    high = syndrome(np.arange(4096, dtype=np.int64) << 11)  # low 11 bits are their own remainder
    return errors, counts, high


def nearby(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 12-bit indices of the codewords within 4 bits of each word [n, 6], the nearest first, and how many there are."""
    errors, counts, high = tables()
    w = words.astype(np.int64)
    s = high[w >> 11] ^ (w & 2047)
    # the code is systematic in its upper 12 bits: they are the index
    return (w[:, None] ^ errors[s]) >> 11, counts[s]


def parity(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words.astype(np.uint64)) & 1
