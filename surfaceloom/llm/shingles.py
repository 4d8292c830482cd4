"""Word shingles of whole texts as sets of 64-bit numbers, for many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from surfaceloom.llm.common import byte_words, joined_bytes, mix

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_WORDS = byte_words(3)[_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Powers that a worker keeps, and bytes that are hashed at once (a longer word is taken as a whole).
KEPT = 1 << 19
_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """The powers of the base and of its inverse, modulo 2**64; the first KEPT are kept between calls."""

    def made(count: int) -> list[np.ndarray]:
        out = []
        for base in (_BASE, _BACK):
            all_ = np.full(count, base)
            all_[0] = 1
            out.append(np.multiply.accumulate(all_))
        return out

    if n > KEPT:
        return made(n)
    if not _powers:
        _powers.extend(made(KEPT))
    return [_powers[0][:n], _powers[1][:n]]


def interval_hashes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, words: np.ndarray = _WORDS) -> np.ndarray:
    """A number for the bytes in each interval from a to b. Intervals rise and don't overlap; words: byte_words(), by byte."""
    out = np.empty(len(a), np.uint64)
    k = 0
    while k < len(a):
        to = max(k + 1, int(np.searchsorted(b, a[k] + KEPT // 2, "right")))
        low, high = a[k], b[to - 1]
        up, down = powers(int(high - low) + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(words[raw[low:high]] * up[:-1], out=sums[1:])
        out[k:to] = (sums[b[k:to] - low] - sums[a[k:to] - low]) * down[a[k:to] - low]
        k = to
    return mix(out)


def word_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, A-Z taken as a-z, and where each row's words start (one more for the end)."""
    raw, starts = joined_bytes(text)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    inside = ~_BLANK[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[starts] = True
    a = np.flatnonzero(inside & (edge[:-1] | ~np.append(False, inside[:-1])))
    b = np.flatnonzero(inside & (edge[1:] | ~np.append(inside[1:], False))) + 1
    return interval_hashes(raw, a, b), np.searchsorted(a, starts)


def sets(text: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingles of n words, rising, and where each row's start (one more for the end).

    A row with fewer words has its whole sequence as one shingle; a row without words, or null, has none.
    """
    words, at = word_hashes(text)
    have = np.diff(at)
    count = np.where(have >= n, have - n + 1, (have > 0).astype(np.int64))
    ends = np.zeros(len(at), np.int64)
    np.cumsum(count, out=ends[1:])
    row = np.repeat(np.arange(len(have)), count)
    first = at[row] + np.arange(ends[-1]) - ends[row]
    padded = np.append(words, np.zeros(n, np.uint64))
    total = np.zeros(len(first), np.uint64)
    short = have[row]
    for k in range(n):
        total = total * np.uint64(0xC2B2AE3D27D4EB4F) + np.where(k < short, padded[first + k], np.uint64(k + 1))
    hashes = mix(total)
    for r in np.flatnonzero(count > 1):
        hashes[ends[r] : ends[r + 1]].sort()
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    out = np.zeros(len(at), np.int64)
    np.cumsum(np.bincount(row[keep], minlength=len(have)), out=out[1:])
    return hashes[keep], out
