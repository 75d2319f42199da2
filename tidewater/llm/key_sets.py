"""Sorted sets of 64-bit keys with counts, as few bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def planes(values: np.ndarray) -> bytes:
    """Whole numbers by their lowest, next, ... bytes, as many as the largest needs."""
    wide = values.astype("<u8")
    size = (int(wide.max()).bit_length() + 7) // 8 if len(wide) else 0
    return wide.view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def numbers(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, : len(data) // n] = np.frombuffer(data, np.uint8).reshape(-1, n).T
    return out.reshape(-1).view("<u8")


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys, as differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(numbers(data, n), dtype=np.uint64)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, as they come, and for each key its place among them."""
    coded = pa.array(keys).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()
