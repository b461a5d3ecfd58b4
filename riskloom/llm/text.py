"""Hashes of words and of runs of words, inside Arrow batches."""

from __future__ import annotations

from functools import cache

import numpy as np

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LONG = 1 << 12  # factors up to this word length are kept


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@cache
def odd_numbers(n: int, seed: int) -> np.ndarray:
    """Fixed pseudo-random odd multipliers."""
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def grams(hashes: np.ndarray, n: int, seed: int = 5) -> np.ndarray:
    """One 64-bit hash per n consecutive words."""
    if len(hashes) < n:
        return hashes[:0]
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i, c in enumerate(odd_numbers(n, seed)):
        out += hashes[i:len(hashes) - n + 1 + i] * c
    return mixed(out)


@cache
def _kept_factors() -> np.ndarray:
    return mixed(np.arange(1, LONG + 1, dtype=np.uint64)) | np.uint64(1)


def _factors(n: int) -> np.ndarray:
    return _kept_factors() if n <= LONG else mixed(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hash of each word: a maximal run without space, tab, line feed, vertical tab, form feed or carriage
    return, A-Z lower-cased. Each byte counts times a factor of its place in the word."""
    if not text:
        return np.zeros(0, np.uint64)
    b = np.frombuffer(text.encode().lower(), np.uint8)
    inside = ~WHITE[b]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))  # in the kept bytes
    sizes = np.diff(np.append(starts, len(at)))
    place = np.arange(len(at)) - np.repeat(starts, sizes)
    factors = _factors(int(sizes.max()))
    return mixed(np.add.reduceat((b[at].astype(np.uint64) + np.uint64(1)) * factors[place], starts))
