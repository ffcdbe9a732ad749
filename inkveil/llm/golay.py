"""The binary Golay code of length 23 as lookup tables, and keys from nearby codewords."""

from __future__ import annotations

import functools
import itertools

import numpy as np

GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
LENGTH, CHECKS = 23, 11


def syndrome(word: int) -> int:
    """Remainder of a 23-bit word by the generator."""
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECKS)
    return word


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits; for each syndrome its error patterns.

    Every word has one codeword within three bits, and, where that is three bits away, five
    more at four bits: one or six patterns, -1 where there is none.
    """
    low = np.array([syndrome(x) for x in range(1 << 12)], np.int64)
    high = np.array([syndrome(x << 12) for x in range(1 << 11)], np.int64)
    patterns = np.full((1 << CHECKS, 6), -1, np.int64)
    used = np.zeros(1 << CHECKS, int)
    for weight in range(5):
        for places in itertools.combinations(range(LENGTH), weight):
            error = sum(1 << p for p in places)
            s = syndrome(error)
            patterns[s, used[s]] = error
            used[s] += 1
    return low, high, patterns


def indices(words: np.ndarray) -> np.ndarray:
    """For each word up to six 12-bit codeword indices, -1 where there is none.

    Two words that differ in at most one bit share an index.
    """
    low, high, patterns = tables()
    errors = patterns[low[words & 0xFFF] ^ high[words >> 12]]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> CHECKS)


#: Bits of the three segments of a fingerprint.
SEGMENTS = (22, 21, 21)


def keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for 64-bit fingerprints: up to 18 keys each.

    Two differing bits leave one of three segments whole, and, of the whole ones, one whose
    successor differs in at most one bit.  So a key is a segment as it is with a codeword index
    of the next segment: fingerprints at two or fewer differing bits share a key.
    """
    f = fingerprints.astype(np.uint64)
    parts, at = [], 0
    for bits in SEGMENTS:
        parts.append(((f >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64))
        at += bits
    rows, found = [], []
    for i, whole in enumerate(parts):
        near = indices(parts[(i + 1) % 3])
        r, c = np.nonzero(near >= 0)
        rows.append(r)
        found.append((i << 34) | (whole[r] << 12) | near[r, c])
    return np.concatenate(rows), np.concatenate(found)
