"""Prefix polynomial hashes of texts, by code point.

For a text c[0..n), P[i] = sum of c[j] * B^j for j < i, modulo M. The span [l, r) then has the
position-free hash (P[r] - P[l]) * B^-l, so any two spans are compared in constant time, and the
longest common extension of two places is found by binary search. M is the Mersenne prime 2^31 - 1,
small enough that every product fits 64 bits; two bases make one hash of 62 bits.
"""

from __future__ import annotations

import numpy as np

M = np.uint64((1 << 31) - 1)
BASES = (1_103_515_245, 69_069_069)
_LOW = np.uint64((1 << 31) - 1)
_31 = np.uint64(31)
_powers: dict[int, np.ndarray] = {}


def modulo(x: np.ndarray) -> np.ndarray:
    """x mod 2^31 - 1 for any 64-bit x, without division."""
    x = (x & _LOW) + (x >> _31)
    x = (x & _LOW) + (x >> _31)
    return np.where(x >= M, x - M, x)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo M; a table that grows by doubling."""
    table = _powers.get(base, np.ones(1, np.uint64))
    while len(table) < n:
        step = np.uint64(int(table[-1]) * base % int(M))
        table = np.concatenate((table, modulo(table * step)))
    _powers[base] = table
    return table[:n]


def inverse(base: int) -> int:
    return pow(base, int(M) - 2, int(M))


class PrefixHash:
    """Prefix arrays over code points; many texts may lie one after another in ``points``."""

    def __init__(self, points: np.ndarray):
        self.points, self.n = points, len(points)
        c = points.astype(np.uint64) + np.uint64(1)  # no letter counts as nothing
        self.prefix = []
        for base in BASES:
            p = np.zeros(self.n + 1, np.uint64)
            np.cumsum(modulo(c * powers(base, self.n)), out=p[1:])  # under 2^31 a place: 2^33 places fit
            self.prefix.append(modulo(p))

    def spans(self, l: np.ndarray, r: np.ndarray) -> np.ndarray:
        """62-bit hashes of the spans [l, r), whatever their place."""
        out = None
        for base, p in zip(BASES, self.prefix):
            back = powers(inverse(base), self.n + 1)
            h = modulo(modulo(p[r] + M - p[l]) * back[l])
            out = h if out is None else (out << _31) | h
        return out

    def equal(self, l1: int, l2: int, length: int) -> bool:
        """Whether two spans of one length are equal."""
        at = np.array([l1, l2])
        a, b = self.spans(at, at + length)
        return bool(a == b)

    def common(self, l1: np.ndarray, l2: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Longest common extension of each pair of places, up to ``most``: binary search over span equality."""
        low, high = np.zeros(len(l1), np.int64), most.astype(np.int64).copy()
        while (open_ := low < high).any():
            mid = np.where(open_, (low + high + 1) // 2, low)
            same = self.spans(l1, l1 + mid) == self.spans(l2, l2 + mid)
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        return low


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, and where each text begins (and the last ends)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return points, np.concatenate(([0], np.cumsum(lengths)))
