"""Words of texts as spans of their UTF-8 bytes, and as exact codes: equal words, and only these, have one code."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are read together, unless one text is longer.
AT_ONCE = 4 << 20


@dataclass
class Words:
    """The words of a run of texts; text t has the words ``begin[t]`` to ``begin[t + 1]``."""

    first: int  # the run's first text
    last: int  # one past its last
    data: np.ndarray  # the run's bytes
    start: np.ndarray
    end: np.ndarray
    begin: np.ndarray

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """A code for each word, and the strings by code (separators may be among them)."""
        n = len(self.start)
        if not n:
            return np.zeros(0, np.int32), pa.array([], pa.binary())
        edges = np.stack((self.start, self.end), 1).ravel().astype(np.int32)  # words and what lies between them by turns
        found = pa.Array.from_buffers(pa.binary(), 2 * n - 1, [None, pa.py_buffer(edges), pa.py_buffer(self.data)]).dictionary_encode()
        return found.indices.to_numpy()[::2], found.dictionary

    def joined(self, keep: np.ndarray) -> pa.Array:
        """Each text's kept words, joined by one space."""
        start, size = self.start[keep], (self.end - self.start)[keep] + 1
        upto = np.concatenate(([0], np.cumsum(size)))
        out = np.full(upto[-1], 32, np.uint8)
        step = AT_ONCE
        at = 0
        while at < len(start):  # the bytes of a slice of words at once
            stop = max(at + 1, int(np.searchsorted(upto, upto[at] + step, side="right")) - 1)
            copied = size[at:stop] - 1
            place = np.arange(copied.sum()) - np.repeat(np.cumsum(copied) - copied, copied)
            out[place + np.repeat(upto[at:stop], copied)] = self.data[place + np.repeat(start[at:stop], copied)]
            at = stop
        kept = np.concatenate(([0], np.cumsum(keep)))[self.begin]
        ends = upto[kept]
        # A text's last space goes: texts are cut out of the row of words by their offsets, one byte short.
        some = np.diff(kept) > 0
        last = np.zeros(len(out), bool)
        last[ends[1:][some] - 1] = True
        offsets = np.concatenate(([0], np.cumsum(np.diff(ends) - some)))
        return pa.Array.from_buffers(pa.large_string(), len(some), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out[~last])])


def word_spans(column: pa.Array, separator: np.ndarray, lower: np.ndarray | None = None, at_once: int = AT_ONCE) -> Iterator[Words]:
    """The words of a string column without nulls, a run of texts at a time; ``separator`` marks the bytes between words, ``lower`` maps bytes first."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], "<i8")[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + at_once, side="right")) - 1)
        own = offsets[i : j + 1] - offsets[i]
        some = data[offsets[i] : offsets[j]]
        if lower is not None:
            some = lower[some]
        inside = ~separator[some]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        breaks = own[:-1][own[:-1] < own[-1]]
        begins[breaks] = inside[breaks]
        inner = breaks[breaks > 0] - 1
        ends[inner] = inside[inner]
        start = np.flatnonzero(begins)
        yield Words(i, j, some, start, np.flatnonzero(ends) + 1, np.searchsorted(start, own))
        i = j
