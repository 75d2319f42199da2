"""Words of texts as 64-bit hashes, straight from the UTF-8 bytes of an Arrow column.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return; A-Z count as a-z. A word's bytes are mixed eight at a time, and words of over 32 bytes are
digested by BLAKE2b, so that no structure of a word makes its hash meet another's. A second,
independent hash of each word makes 128 bits where sets are verified. Texts are read in slices of
bounded size, cut between words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once, unless one word is longer.
SLICE = 1 << 20
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
#: For words of letters only: every ASCII byte but the letters separates.
NO_LETTER = np.arange(256) < 128
NO_LETTER[65:91] = NO_LETTER[97:123] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Lanes of eight bytes that are mixed; fixed odd multipliers of the two hashes; and masks of the first bytes of a lane.
LANES = 4
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hashed(data: np.ndarray, breaks: np.ndarray, separator: np.ndarray, hashes: int) -> tuple[list[np.ndarray], np.ndarray]:
    """One or two hashes, and the begin, of each word of ``data``; a word also begins at each place in ``breaks``."""
    n = len(data)
    inside = ~separator[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[breaks] = inside[breaks]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    inner = breaks[breaks > 0] - 1
    ends[inner] = inside[inner]
    b, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    lower = np.zeros(n + 8, np.uint8)
    lower[:n] = LOWER[data]
    return span_hashes(lower, b, e, hashes), b


def span_hashes(lower: np.ndarray, b: np.ndarray, e: np.ndarray, hashes: int = 1) -> list[np.ndarray]:
    """One or two hashes of each word [b, e) of bytes that eight zeros follow."""
    size = e - b
    lane = np.ndarray((len(lower) - 7,), "<u8", lower, strides=(1,))
    first = lane[b] & _MASK[np.minimum(size, 8)]
    out = [mix(mix(first + odd) ^ size.astype(np.uint64) * odd) for odd in _ODD[:hashes]]
    for k in range(1, LANES):
        more = np.flatnonzero(size > 8 * k)
        if not len(more):
            break
        value = lane[b[more] + 8 * k] & _MASK[np.minimum(size[more] - 8 * k, 8)]
        for h, odd in zip(out, _ODD):
            h[more] = mix(h[more] + (value ^ odd) * odd)
    for k in np.flatnonzero(size > 8 * LANES).tolist():
        digest = np.frombuffer(hashlib.blake2b(lower[b[k] : e[k]].tobytes(), digest_size=16).digest(), "<u8")
        for h, d in zip(out, digest):
            h[k] = d
    return out


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The hash of each of a list of words (A-Z count as a-z)."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    begin = (np.cumsum(size) - size)[size > 0]
    out = np.zeros(len(words), np.uint64)
    data = np.frombuffer(b"".join(words), np.uint8)
    if len(data):
        out[size > 0] = _hashed(data, begin, np.zeros(256, bool), 1)[0][0]
    return out


def column_words(column: pa.Array, separator: np.ndarray = SEPARATOR, at_once: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, one past the last, word hashes, where each text's words begin, and the last's end) for runs of texts of a string column without nulls."""
    for first, last, (words,), begin in _column_words(column, separator, at_once, 1):
        yield first, last, words, begin


def _column_words(column: pa.Array, separator: np.ndarray, at_once: int, hashes: int) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray]]:
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], "<i8")[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + at_once, side="right")) - 1)
        begin, end = int(offsets[i]), int(offsets[j])
        if end - begin <= 2 * at_once:
            own = offsets[i : j + 1] - begin
            h, at = _hashed(data[begin:end], own[:-1][own[:-1] < end - begin], separator, hashes)
            yield i, j, h, np.searchsorted(at, own)
        else:
            parts = []
            while begin < end:
                stop = min(begin + at_once, end)
                while stop < end and not separator[data[stop]]:
                    more = np.flatnonzero(separator[data[stop : stop + at_once]])
                    stop = stop + int(more[0]) if len(more) else min(stop + at_once, end)
                parts.append(_hashed(data[begin:stop], np.zeros(1, np.int64), separator, hashes)[0])
                begin = stop
            h = [np.concatenate(p) for p in zip(*parts)]
            yield i, j, h, np.array([0, len(h[0])])
        i = j


def _shingles(words: np.ndarray, begin: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the k words from each place on; and for each text one of its whole sequence, if that has fewer words."""
    odd = np.random.default_rng(seed).integers(1 << 62, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)  # no places in proportion
    mixed = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for p in range(k):
        mixed += words[p : p + len(mixed)] * odd[p]
    short = np.zeros(len(begin) - 1, np.uint64)
    size = np.diff(begin)
    for p in range(k - 1):
        some = np.flatnonzero((size > p) & (size < k))
        short[some] += words[begin[some] + p] * odd[p]
    return mix(mixed), mix(short + size.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, sorted distinct k-word shingles of a run of texts, where each set begins and the last ends). Texts of fewer words have their whole sequence as one; without words, none."""
    for first, sets, _, begin in _shingle_sets(column, k, 1):
        yield first, sets, begin


def checked_shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``shingle_sets`` with a second, independent hash of each shingle beside the first."""
    yield from _shingle_sets(column, k, 2)


def _shingle_sets(column: pa.Array, k: int, hashes: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for first, _, words, begin in _column_words(column, SEPARATOR, SLICE, hashes):
        made = [_shingles(w, begin, k, 70 + s) for s, w in enumerate(words)]
        (mixed, short), (check, short_check) = made[0], made[-1]
        sets, checks = [mixed[:0]], [mixed[:0]]
        for t, (b, size) in enumerate(zip(begin.tolist(), np.diff(begin).tolist())):
            if size >= k:
                own = mixed[b : b + size - k + 1]
                if hashes == 1:
                    sets.append(np.unique(own))
                else:
                    own, at = np.unique(own, return_index=True)
                    sets.append(own)
                    checks.append(check[b : b + size - k + 1][at])
            else:
                sets.append(short[t : t + (size > 0)])
                checks.append(short_check[t : t + (size > 0)])
        sizes = np.fromiter(map(len, sets[1:]), np.int64, len(sets) - 1)
        yield first, np.concatenate(sets), np.concatenate(checks), np.concatenate(([0], np.cumsum(sizes)))
