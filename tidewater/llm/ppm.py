"""Prediction by partial matching over bytes: the trie of contexts as sorted arrays, one for each order.

A text is the bytes of its words (A-Z lower-cased) with a space between two words and a line feed at the
end; before its beginning stand line feeds. A place's context is the ``ORDER`` bytes before it, the
nearest first, so that all contexts which share a suffix lie together, and a node of a lower order is
a range of those of the next. The count of a symbol at a node of the highest order is how often it follows
there; at a lower node, in how many contexts one byte longer it does.

A symbol is looked for from the longest context down. At a node whose symbols have the counts n, T in
all and d of them, a symbol has the share (n - D) / T and the escape D d / T; symbols that a longer
context already offered are excluded from n, T and d. Below order 0, the bytes that are left have equal shares.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes of context, and what every count gives to the escape.
ORDER, DISCOUNT = 6, 0.35
#: The highest order whose nodes every task holds: a node and its symbol are three bytes, so there are at most 2^24 entries.
LOW = 2
#: Bytes that a text may have: all but the separators, with space and line feed.
ALPHABET = 252
_8 = np.uint64(8)
_BYTE = np.uint64(255)


def grams(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A key for each byte: its context, the nearest byte highest, then the byte itself. Text t begins at ``begin[t]``."""
    n = len(data)
    at = np.arange(n) - np.repeat(begin[:-1], np.diff(begin))  # place in its text
    out = np.zeros(n, np.uint64)
    padded = np.concatenate((np.full(ORDER, 10, np.uint8), data))
    for k in range(1, ORDER + 1):
        before = padded[ORDER - k : ORDER - k + n].astype(np.uint64)
        early = np.flatnonzero(at < k)
        before[early] = 10
        out = out << _8 | before
    return out << _8 | data


def entry(keys: np.ndarray, order: int, of: int = ORDER) -> np.ndarray:
    """A key's context of a lower order with its symbol."""
    cut = np.uint64(8 * (of - order))
    return keys >> _8 >> cut << _8 | keys & _BYTE


@dataclass
class Level:
    """The nodes of one order: entries (context, symbol), sorted, and running sums of their counts."""

    keys: np.ndarray
    sums: np.ndarray  # of the counts, from 0
    below: np.ndarray  # of the counts that the same symbols have one order down, from 0

    @staticmethod
    def of(keys: np.ndarray, counts: np.ndarray, order: int, lower: Level | None) -> Level:
        under = lower.counts(entry(keys, order - 1, order)) if lower is not None else np.zeros(len(keys), np.int64)
        return Level(keys, _sums(counts), _sums(under))

    def counts(self, entries: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(entries), np.int64)
        at = np.minimum(np.searchsorted(self.keys, entries), len(self.keys) - 1)
        return np.where(self.keys[at] == entries, self.sums[at + 1] - self.sums[at], 0)

    def nodes(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the entries of the contexts begin and end."""
        context = entries & ~_BYTE
        return np.searchsorted(self.keys, context), np.searchsorted(self.keys, context | _BYTE, side="right")


def _sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(x, dtype=np.int64)))


def shortened(keys: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct entries of the order below, and how many entries of this order shorten to each."""
    return np.unique(entry(keys, order - 1, order), return_counts=True)


def levels(keys: np.ndarray, counts: np.ndarray, order: int, down_to: int, lower: Level | None) -> dict[int, Level]:
    """The nodes of the orders ``order`` to ``down_to`` from distinct sorted entries of the highest; ``lower`` is the order below the last."""
    entries = {order: (keys, counts)}
    for k in range(order, down_to, -1):
        entries[k - 1] = shortened(entries[k][0], k)
    out: dict[int, Level] = {}
    for k in range(down_to, order + 1):
        out[k] = lower = Level.of(*entries[k], k, lower)
    return out


def log_probabilities_of_seen(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``log_probabilities`` of all entries of whole nodes of the highest order."""
    first = np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] >> _8 != keys[:-1] >> _8))
    total = np.bincount(np.cumsum(first) - 1, counts)
    return np.log((counts - DISCOUNT) / total[np.cumsum(first) - 1])


def log_probabilities(keys: np.ndarray, trie: dict[int, Level]) -> np.ndarray:
    """Natural logarithm of the probability of each key's symbol after its context."""
    out = np.zeros(len(keys))
    left = np.arange(len(keys))  # those not found yet
    taken_n, taken_d = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)  # what longer contexts offered, by counts and symbols of this order
    for k in range(ORDER, -1, -1):
        if not len(left):
            return out
        level, own = trie[k], entry(keys[left], k)
        a, b = level.nodes(own)
        total = level.sums[b] - level.sums[a] - taken_n
        distinct = b - a - taken_d
        n = level.counts(own)
        some, found = total > 0, n > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            out[left] += np.where(found, np.log((n - DISCOUNT) / total), np.where(some, np.log(DISCOUNT * distinct / total), 0.0))
        rest = ~found
        left, taken_n, taken_d = left[rest], (level.below[b] - level.below[a])[rest], (b - a)[rest]
    out[left] -= np.log(ALPHABET - taken_d)
    return out
