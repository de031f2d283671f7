"""Words and hashes of many texts at once, on numpy arrays of UTF-8 bytes."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: An odd multiplier and its inverse modulo 2**64: powers of it weigh the bytes of a word.
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]
_rng = np.random.default_rng(20240517)
#: A random 64-bit number for each byte value.
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
WS = np.zeros(256, bool)
WS[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        for k, base in enumerate((_P, _PINV)):
            a = np.full(size, base, U)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Hasher:
    """Hashes of byte spans of one buffer, each in constant time."""

    def __init__(self, data: np.ndarray):
        pw, self.inv = powers(len(data) + 1)
        self.c = np.zeros(len(data) + 1, U)
        np.cumsum(BYTE[data] * pw[:-1], out=self.c[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.c[end] - self.c[start]) * self.inv[start])


def words(data: np.ndarray, offs: np.ndarray, space: np.ndarray = WS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every maximal run of bytes that aren't white space."""
    ok = ~space[data]
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.zeros(n + 1, bool)
    first[offs[:-1]] = True  # every text begins anew
    before = np.zeros(n, bool)
    before[1:] = ok[:-1]
    start = np.flatnonzero(ok & (~before | first[:n]))
    after = np.zeros(n, bool)
    after[:-1] = ok[1:]
    last = np.zeros(n + 1, bool)
    last[offs[1:]] = True
    end = np.flatnonzero(ok & (~after | last[1:])) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1
