"""Words and word shingles of many texts at once, as 64-bit hashes in numpy.

A slice of texts is one byte array. A word's hash is the difference of two prefix sums
of a polynomial over the bytes, so no Python object is made per word.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_POSITION = np.array([pow(0xD6E8FEB86659FD93, j + 1, 2**64) | 1 for j in range(64)], U64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes between words: space and the controls from tab to carriage return.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

#: The same with everything in ASCII that is neither a letter nor a digit.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = True
for _low, _high in ("09", "AZ", "az"):
    NOT_ALNUM[ord(_low) : ord(_high) + 1] = False

_powers = {"power": np.ones(1, U64), "inverse": np.ones(1, U64)}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers["power"]) < n:
        for name, base in (("power", _BASE), ("inverse", _BASE_INVERSE)):
            table = np.full(n, base, U64)
            table[0] = 1
            _powers[name] = np.cumprod(table)
    return _powers["power"], _powers["inverse"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and each text's first index into them.

    Letters A-Z are lower-cased. ``between`` says which bytes separate words.
    """
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    inside = ~between[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
    begin[heads] = inside[heads]
    end[tails] = inside[tails]
    starts, stops = np.flatnonzero(begin), np.flatnonzero(end) + 1
    power, inverse = _power_table(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum((LOWER[data].astype(U64) + U64(1)) * power[:n], out=sums[1:])
    value = (sums[stops] - sums[starts]) * inverse[starts]
    return mix(value + (stops - starts).astype(U64) * U64(0xA24BAED4963EE407)), np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of ``size`` words, and each text's first index into them.

    A text with fewer words, but at least one, has its whole sequence as one shingle.
    """
    counts = np.diff(first)
    left = np.repeat(first[1:], counts) - np.arange(len(hashes))
    total = np.minimum(left, size).astype(U64) * U64(0xC2B2AE3D27D4EB4F)
    for j in range(size):
        shifted = hashes[j:] * _POSITION[j]
        total[: len(shifted)] += np.where(left[: len(shifted)] > j, shifted, U64(0))
    valid = left >= size
    short = first[:-1][(counts > 0) & (counts < size)]
    valid[short] = True
    per_text = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    return mix(total[valid]), np.concatenate([[0], np.cumsum(per_text)])
