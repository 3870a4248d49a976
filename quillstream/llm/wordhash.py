"""Vectorised hashes of words and of windows of words over the bytes of many texts at once.

A word's hash is a polynomial over its bytes modulo 2^64: prefix sums give every word's value with
a handful of array operations. A window's hash is the same construction over the words' hashes.
All constants are derived from a seed, so runs on all machines agree.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown when longer inputs arrive."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        base = int(rng.integers(1 << 62, dtype=np.uint64)) * 8 + 5
        self.base, self.inverse = base % 2**64, pow(base, -1, 2**64)
        self.up, self.down = np.ones(1, _U), np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * _U(pow(self.base, k, 2**64))])
            self.down = np.concatenate([self.down, self.down * _U(pow(self.inverse, k, 2**64))])
        return self.up[:n], self.down[:n]


class Hasher:
    """Hashes for one seed. Two seeds give two independent 64-bit values, 128 bits together."""

    def __init__(self, seed: int, lower: bool = False) -> None:
        rng = np.random.default_rng([seed, 1])
        self.table = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        if lower:
            self.table[65:91] = self.table[97:123]
        self.bytes, self.windows = Powers(seed + 1000), Powers(seed + 2000)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """The running sums; entry i covers the first i bytes."""
        up, _ = self.bytes.upto(len(data) + 1)
        out = np.zeros(len(data) + 1, _U)
        np.cumsum(self.table[data] * up[:-1], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, down = self.bytes.upto(len(sums))
        return mix((sums[end] - sums[start]) * down[start])

    def ngrams(self, words: np.ndarray, n: int) -> np.ndarray:
        """The hash of every n consecutive words (also across texts; see ``inside``)."""
        if len(words) < n:
            return np.zeros(0, _U)
        up, down = self.windows.upto(len(words) + 1)
        sums = np.zeros(len(words) + 1, _U)
        np.cumsum(words * up[: len(words)], out=sums[1:])
        return mix((sums[n:] - sums[:-n]) * down[: len(words) - n + 1])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the bytes, and for the n texts the n + 1 bounds in the words."""
    space = _SPACE[data]
    edge = np.ones(len(data) + 1, bool)
    edge[:-1] = space
    # A word starts where no space follows a space or a text's start, and ends likewise.
    first = ~space
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts] = True
    start = np.flatnonzero(first & before)
    after = edge[1:].copy()
    after[cuts - 1] = True
    end = np.flatnonzero(first & after) + 1
    return start, end, np.searchsorted(start, offsets)


def inside(bounds: np.ndarray, n: int) -> np.ndarray:
    """For each n-gram of all words, whether it lies within one text."""
    total = int(bounds[-1])
    if total < n:
        return np.zeros(0, bool)
    ok = np.ones(total - n + 1, bool)
    inner = bounds[1:-1]
    for k in range(1, n):
        at = inner - k
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok
