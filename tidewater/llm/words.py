"""Vectorised word splitting and hashing of whole batches of text.

A word is a maximal run of ASCII letters, ASCII digits and bytes from 0x80 on
(so every non-ASCII character counts as a letter); ASCII letters are folded to
lower case.  Null and empty texts have no words.  All positions are byte
positions in the UTF-8 form of the text.
"""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_MULT = _U(0x9E3779B97F4A7C15)

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = True
IS_WORD[128:] = True

_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash multiplier, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1024)
        with np.errstate(over="ignore"):
            _powers = np.concatenate(([_U(1)], np.cumprod(np.full(size - 1, _MULT))))
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
        return h ^ (h >> _U(33))


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; the ranges follow one another without gaps, and none is empty."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    size = end - start
    offset = np.arange(start[0], end[-1]) - np.repeat(start, size)
    with np.errstate(over="ignore"):
        terms = _TABLE[data[start[0] : end[-1]]] * powers(int(size.max()))[offset]
        return mix(np.add.reduceat(terms, start - start[0]) + size.astype(np.uint64))


class Words:
    """The words of a list of UTF-8 texts.

    ``data`` are the folded bytes of all texts joined by one zero byte;
    ``start``/``end`` the words' byte ranges in it; ``first`` (one longer than
    the list) the index of each text's first word; ``base`` the place of each
    text in ``data``.
    """

    def __init__(self, raw: list[bytes]) -> None:
        joined = b"\0".join(raw) + b"\0"
        self.data = FOLD[np.frombuffer(joined, dtype=np.uint8)]
        sizes = np.fromiter((len(x) + 1 for x in raw), dtype=np.int64, count=len(raw))
        self.base = np.concatenate(([0], np.cumsum(sizes)))
        inside = IS_WORD[self.data]
        edge = np.flatnonzero(np.diff(inside, prepend=False))  # the last byte is never a letter
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.base)
        self._inside = inside

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        size = self.end - self.start
        letters = self.data[self._inside]
        ends = np.cumsum(size)
        begins = ends - size
        offset = np.arange(len(letters)) - np.repeat(begins, size)
        with np.errstate(over="ignore"):
            terms = _TABLE[letters] * powers(int(size.max()))[offset]
            return mix(np.add.reduceat(terms, begins) + size.astype(np.uint64))

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, one place each, index of each word among them)."""
        return np.unique(self.hashes(), return_index=True, return_inverse=True)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def md5_low(word: bytes) -> int:
    """The lower 64 bits (first eight bytes, little endian) of the word's MD5."""
    return int.from_bytes(hashlib.md5(word).digest()[:8], "little")


def spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts per row: (row of each element, its number within the row)."""
    rows = np.repeat(np.arange(len(count)), count)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
