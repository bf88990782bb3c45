"""Runs of windows that share a minimiser (super-k-mers), for sequences of hashed units: words or bytes."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def kmer_hashes(units: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Order-dependent hash of every k units (k a power of two), another one for every seed; positions near the end hold less
    and aren't to be used."""
    h, have, base = units.astype(np.uint64, copy=True), 1, 0x100000001B3
    while have < k:
        factor = np.uint64(pow(base, have, 1 << 64))
        h[:-have] = h[:-have] * factor + h[have:]
        have *= 2
    return _scramble(h * _ODD ^ np.uint64(seed * 0xD1B54A32D192ED03 & (1 << 64) - 1))


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Least of every w values, by doubling; result has len(h) - w + 1 values."""
    have, m = 1, h
    while 2 * have <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return m if have == w else np.minimum(m[: len(h) - w + 1], m[w - have : w - have + len(h) - w + 1])


def super_kmers(units: np.ndarray, bounds: np.ndarray, window: int, k: int, seed: int = 0):
    """units: hashes of all sequences in a row; bounds: where each begins, and the end.

    Returns arrays (sequence, start, windows, minimiser): maximal runs of consecutive windows of one sequence whose least
    k-unit hash is the same; start counts in the sequence. Equal windows have equal minimisers wherever they stand.
    """
    n = len(units)
    none = np.empty(0, np.int64)
    count = np.maximum(np.diff(bounds) - window + 1, 0)
    if n < window or not count.any():
        return none, none, none, none.astype(np.uint64), np.empty(0, np.uint64)
    h = kmer_hashes(units, k, seed)[: n - k + 1]
    least = sliding_min(h, window - k + 1)
    seq = np.flatnonzero(count)
    first = bounds[seq]
    # all valid windows, sequence by sequence
    total = int(count[seq].sum())
    before = np.cumsum(count[seq]) - count[seq]
    at = np.repeat(first - before, count[seq]) + np.arange(total)
    low = least[at]
    cut = np.empty(total, bool)
    cut[0] = True
    np.not_equal(low[1:], low[:-1], out=cut[1:])
    cut[before] = True
    runs = np.flatnonzero(cut)
    size = np.diff(np.append(runs, total))
    owner = np.searchsorted(before, runs, "right") - 1
    return seq[owner], at[runs] - first[owner], size, low[runs], h


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All indices of the ranges [start, start + size), in a row."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
