"""Words and word shingles of many texts at once, as 64-bit numbers.

Words are runs of bytes other than white space, ASCII letters in lower case. A word's number is a
polynomial in its bytes, taken from running sums, so that numpy works on whole columns.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
#: Of each byte: one more than its lower case, and whether it belongs to a word.
LOWER = np.arange(1, 257, dtype=np.uint64)
LOWER[65:91] += np.uint64(32)
INSIDE = np.ones(256, bool)
INSIDE[[32, *range(9, 14)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse up to at least n; a worker keeps one table of them."""
    if not _powers or len(_powers[0]) <= n:
        size = max(1 << 20, 1 << n.bit_length()) + 1
        up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = np.cumprod(up, out=up), np.cumprod(down, out=down)
    return _powers


def word_bounds(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and where it stops; a text's edge ends a word."""
    n = len(data)
    inside = INSIDE[data]
    fresh = np.zeros(n + 1, bool)
    fresh[ends] = True
    before = np.concatenate([[False], inside])[:n] & ~fresh[:n]
    after = np.concatenate([inside[1:], [False]])[:n] & ~fresh[1:]
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def word_numbers(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of all words in order, where each starts and where it stops."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    starts, stops = word_bounds(data, ends)
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(LOWER[data] * up[:n], out=sums[1:])
    numbers = (sums[stops] - sums[starts]) * down[starts]
    numbers = mix(numbers + (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return numbers, starts, stops


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of all words in order, and per text the first word and the one behind its last."""
    numbers, starts, _ = word_numbers(data, ends)
    return numbers, np.searchsorted(starts, ends[:-1]), np.searchsorted(starts, ends[1:])


def shingle_sets(data: np.ndarray, ends: np.ndarray, size: int) -> list[np.ndarray]:
    """Per text the ascending distinct numbers of its shingles of ``size`` words.

    A text with fewer words has its whole sequence as one; one without words has none.
    """
    numbers, first, last = words(data, ends)
    factors = [np.uint64(pow(BASE, 3 + 2 * k, 1 << 64)) for k in range(size)]
    whole = max(0, len(numbers) - size + 1)
    runs = np.zeros(whole, np.uint64)
    for k, factor in enumerate(factors):
        runs += numbers[k : k + whole] * factor
    runs = mix(runs)
    sets = []
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= size:
            sets.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            short = sum(int(x) * int(f) for x, f in zip(numbers[a:b], factors)) + (b - a) * 0x632BE59BD9B4E019
            sets.append(mix(np.array([short & MASK], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def signature(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed numbers."""
    other = mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    pair = np.array([grams.sum(dtype=np.uint64), other.sum(dtype=np.uint64)], np.uint64)
    return tuple(pair.view(np.int64).tolist())
