"""Hashed features of one text on numpy arrays: character n-grams, words, and whether a word run was seen before."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_STEP, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
#: Characters that are worked on together. Cuts fall anywhere: n-grams read on past them, and words are carried over (``Words``).
BLOCK = 200_000


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def blanks(c: np.ndarray) -> np.ndarray:
    return (c == 32) | ((c >= 9) & (c <= 13))


def blocks(text: str, overlap: int) -> Iterator[str]:
    """Parts of a long text that share ``overlap`` characters, so that every n-gram is in one of them at least."""
    at = 0
    while len(text) - at > BLOCK + overlap:
        yield text[at:at + BLOCK + overlap]
        at += BLOCK
    yield text[at:]


def _slot(h: np.ndarray, salt: int, bits: int) -> np.ndarray:
    return ((h ^ np.uint64(salt * 0x51ED2701)) * _MIX >> np.uint64(64 - bits)).astype(np.int64)


def ngrams(c: np.ndarray, sizes: range, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(n, slots) of the n-grams that start at each place."""
    h = c.copy()
    for n in range(1, sizes.stop):
        if n > 1:
            if len(h) < 2:
                return
            h = h[:-1] * _STEP + c[n - 1:]
        if n in sizes:
            yield n, _slot(h, n, bits)


def subwords(c: np.ndarray, sizes: range, bits: int, starts: int | None = None) -> Iterator[np.ndarray]:
    """n-grams inside a word with its edges: white space may stand first or last, not inside. Only those that begin at the first ``starts`` places, if given."""
    blank = blanks(c)
    c = np.where(blank, np.uint64(32), c)
    upto = np.concatenate([[0], np.cumsum(blank)])
    for n, slot in ngrams(c, sizes, bits):
        inner = upto[n - 1:len(c)] - upto[1:len(c) - n + 2]
        yield slot[:starts][inner[:starts] == 0]


class Words:
    """A 64-bit hash of every word in order, of a text that comes in parts: a word that a part leaves open is carried into the next."""

    def __init__(self) -> None:
        self.open, self.length = np.uint64(0), 0

    def add(self, c: np.ndarray) -> np.ndarray:
        """The words that end in this part."""
        solid = ~blanks(c)
        before = self.end() if self.length and len(c) and not solid[0] else np.zeros(0, np.uint64)
        if not solid.any():
            return before
        new = solid & ~np.concatenate([[False], solid[:-1]])
        starts = np.flatnonzero(new)
        spot = np.arange(len(c)) - np.concatenate([np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.concatenate([starts, [len(c)]])))])
        power = _powers(int(spot.max()) + 1)
        h = np.add.reduceat(np.where(solid, (c + np.uint64(1)) * power[spot], np.uint64(0)), starts)
        if self.length:  # the first word goes on from the part before
            h[:1] = h[:1] * np.uint64(pow(int(_STEP), self.length, 1 << 64)) + self.open
        if solid[-1]:
            self.open, self.length = h[-1], len(c) - int(starts[-1]) + (self.length if len(starts) == 1 else 0)
            h = h[:-1]
        else:
            self.open, self.length = np.uint64(0), 0
        return np.concatenate([before, h * _MIX])

    def end(self) -> np.ndarray:
        """The word that is still open, if there is one."""
        last = np.array([self.open], np.uint64)[:self.length] * _MIX
        self.open, self.length = np.uint64(0), 0
        return last


def words(c: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word in order."""
    w = Words()
    return np.concatenate([w.add(c), w.end()])


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * n, _STEP), dtype=np.uint64)])
    return _POWERS


def seen_before(w: np.ndarray, run: int = 3) -> np.ndarray:
    """For each run of so many words whether an equal run came earlier in the text."""
    if len(w) < run:
        return np.zeros(0, bool)
    h = w[:len(w) - run + 1].copy()
    for k in range(1, run):
        h = h * _STEP + w[k:len(w) - run + 1 + k]
    seen = np.ones(len(h), bool)
    seen[np.unique(h, return_index=True)[1]] = False
    return seen
