"""Words of UTF-8 texts as 64-bit hashes, computed on whole byte arrays at once.

A word's hash is a polynomial over random byte codes modulo 2**64, from differences of running sums, then a
finalising mixer; the cost is a few array operations a byte whatever the number of words. The codes come from a
fixed seed, so that every executor and every run gives the same hash to the same word.
"""

from __future__ import annotations

import numpy as np

_MULT = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LENGTH = np.uint64(0xD6E8FEB86659FD93)
_CODES = np.random.default_rng(20240607).integers(1, (1 << 64) - 1, 256, dtype=np.uint64)

#: Segment length of the tokenizer; words are never cut, so a longer word makes a longer segment.
_SEGMENT = 1 << 20

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        size = max(n + 1, _SEGMENT + 1)
        for k, base in enumerate((_MULT, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, true inside the given inclusive ranges."""
    flags = np.zeros(256, bool)
    for low, high in ranges:
        flags[low : high + 1] = True
    return flags


#: ASCII white space: the space and 0x09 to 0x0D.
SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
#: All but ASCII letters, digits and bytes from 0x80 on.
NOT_ALNUM = ~byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Lower-cases A to Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:  # of arrays: scalars would warn of overflow
    """A bijective mixer of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spans(kind: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of one kind above 0; first marks bytes that begin a text."""
    n = len(kind)
    change = np.empty(n, bool)
    change[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change |= first
    at = np.flatnonzero(change)
    ends = np.append(at[1:], n)
    keep = kind[at] > 0
    return at[keep], ends[keep]


def words(
    data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray, fold: np.ndarray = LOWER
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts that lie one after another in data.

    kinds: for each byte 0 where it parts words, else the number of its class; a word is a run of one class
    inside a text. Returns starts, ends and hashes of the words, and for each text the index of its first word
    (with the number of words at the end).
    """
    n = len(data)
    first = np.zeros(n, bool)
    begins = offsets[:-1]
    first[begins[begins < n]] = True
    starts, ends, hashes, at = [], [], [], 0
    while at < n:
        to = min(n, at + _SEGMENT)
        while to < n and not (first[to] or not kinds[data[to]]):
            step = min(n, to + 4096)
            stops = np.flatnonzero(first[to:step] | (kinds[data[to:step]] == 0))
            to = to + int(stops[0]) if len(stops) else step
        part = data[at:to]
        s, e = _spans(kinds[part], first[at:to])
        up, down = _power_tables(len(part))
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_CODES[fold[part]] * up[: len(part)], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _LENGTH))
        starts.append(s + at)
        ends.append(e + at)
        at = to
    if not starts:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    begin = np.concatenate(starts)
    return begin, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(begin, offsets)


def kinds_of(separators: np.ndarray) -> np.ndarray:
    """Byte classes for words: 0 for separators, 1 for all others."""
    return (~separators).astype(np.uint8)


def segments(values: np.ndarray, bounds: np.ndarray, reduce: np.ufunc, empty: float) -> np.ndarray:
    """reduce over values[bounds[i]:bounds[i + 1]] for each i; empty where that is empty."""
    counts = np.diff(bounds)
    out = np.full(len(counts), empty, values.dtype)
    full = counts > 0
    if full.any():
        out[full] = reduce.reduceat(values, bounds[:-1][full])
    return out
