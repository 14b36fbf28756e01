"""The binary Golay code of length 23 on numpy arrays: syndromes, nearest codewords, shared keys.

The code is perfect: every 23-bit word lies within 3 bits of one codeword. So a word's key set, the codewords nearest to
it and to its 23 one-bit neighbours, has 1 member for words within 2 bits of the code and 6 for all others; and any two words
at most 2 bits apart share a key, because the word between them (or either of them) decodes to it.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

LENGTH, CHECKS = 23, 11
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECKS)
    return word


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and of the high 11 bits, and the error of at most 3 bits behind each syndrome."""
    unit = [_remainder(1 << i) for i in range(LENGTH)]

    def linear(units: list[int]) -> np.ndarray:
        t = np.zeros(1, np.int32)
        for u in units:
            t = np.concatenate([t, t ^ u])
        return t

    error = np.zeros(1 << CHECKS, np.int32)
    for i in range(LENGTH):
        error[unit[i]] = 1 << i
        for j in range(i):
            error[unit[i] ^ unit[j]] = 1 << i | 1 << j
            for k in range(j):
                error[unit[i] ^ unit[j] ^ unit[k]] = 1 << i | 1 << j | 1 << k
    return linear(unit[:12]), linear(unit[12:]), error


def decode(words: np.ndarray) -> np.ndarray:
    """The 12 information bits of the codeword nearest to each word."""
    low, high, error = _tables()
    w = words.astype(np.int32)
    return (w ^ error[low[w & 0xFFF] ^ high[w >> 12]]) >> CHECKS


def keys(words: np.ndarray) -> np.ndarray:
    """Shape (n, 6): the distinct keys of each word in ascending order, padded with -1."""
    flips = np.concatenate([[0], 1 << np.arange(LENGTH)]).astype(np.int32)
    near = np.sort(decode(words.astype(np.int32)[:, None] ^ flips), axis=1)
    new = np.ones(near.shape, bool)
    new[:, 1:] = near[:, 1:] != near[:, :-1]
    place = np.cumsum(new, axis=1) - 1
    out = np.full((len(words), 6), -1, np.int32)
    rows, cols = np.nonzero(new)
    out[rows, place[rows, cols]] = near[rows, cols]
    return out
