"""Document fingerprints from prefix polynomial hashes.

A fingerprint is the hash of the whole text (62 bits) and ``BINS`` bins of a one-permutation
min-hash: every span of ``SPAN`` code points gets its hash from the prefix arrays and takes part,
whatever the length of its text, and each bin keeps the least. The likeness of two fingerprints is
the share of equal bins among those that either fills, so 1 for equal texts and about the
resemblance of their spans else.

``edited`` pairs each document with the next in falling order of doc_id: it replaces the last half of
the text by the first of the next one's (which after the last document is the first).

Defined cases: a null text is empty; an empty text's fingerprint is all empty, its likeness 1 to
another empty text and 0 to any other; rows of equal doc_id follow each other by text; a single
document is its own next one; an empty table gives an empty one; columns other than the two named
are not read; null identifiers come last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, two_columns, written
from .prefix_hash import PrefixHash, code_points

SPAN, BINS = 16, 64
#: So many spans of a text are looked at first, the least by hash: where they fill all bins, no other span can be a bin's least.
FIRST = 1024
#: Code points that are hashed at once (a longer text goes alone).
AT_ONCE = 1 << 19
EMPTY = 0xFFFF
RESULT = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, common_prefix long"
#: What the pass over sorted documents writes: results, and each partition's first and last document.
ROW, HEAD, TAIL = 0, 1, 2
_PASSED = RESULT + ", part int, role int, text string"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.iinfo(np.uint64).max


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sketches(texts: list[str]) -> tuple[np.ndarray, np.ndarray, PrefixHash, np.ndarray]:
    """Bins (texts x BINS, uint16) and whole-text hashes; also the prefix arrays and where the texts begin."""
    points, begin = code_points(texts)
    ph = PrefixHash(points)
    lengths = np.diff(begin)
    whole = ph.spans(begin[:-1], begin[1:])
    spans = np.where(lengths >= SPAN, lengths - SPAN + 1, np.minimum(lengths, 1))
    owner = np.repeat(np.arange(len(texts)), spans)
    l = np.arange(len(owner)) + np.repeat(begin[:-1] - (np.cumsum(spans) - spans), spans)
    h = _mixed(ph.spans(l, np.minimum(l + SPAN, begin[1:][owner])) * _MIX)
    least = _least(h, owner, spans)
    bins = np.where(least == _NONE, EMPTY, _mixed(least) % np.uint64(EMPTY)).astype(np.uint16)
    return bins, whole, ph, begin


def _least(h: np.ndarray, owner: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Texts x BINS: the least hash of all spans in each bin. Spans under a bound by their number go first; a text with a bin that these don't fill takes all of its spans."""
    least = np.full(len(spans) * BINS, _NONE, np.uint64)

    def take(at: np.ndarray) -> None:
        np.minimum.at(least, owner[at] * BINS + (h[at] & np.uint64(BINS - 1)).astype(np.int64), h[at] >> np.uint64(6))

    bound = np.minimum(FIRST / np.maximum(spans, 1), 1.0) * 2.0**58
    low = (h >> np.uint64(6)) <= bound.astype(np.uint64)[owner]
    take(np.flatnonzero(low))
    unfilled = (least.reshape(-1, BINS) == _NONE).any(axis=1) & (spans > FIRST)
    take(np.flatnonzero(~low & unfilled[owner]))
    return least.reshape(-1, BINS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, the share of equal bins among those filled in either."""
    filled = (a != EMPTY) | (b != EMPTY)
    n = filled.sum(axis=1)
    same = ((a == b) & filled).sum(axis=1)
    return np.where(n == 0, 1.0, same / np.maximum(n, 1))


def packed(bins: np.ndarray, whole: np.ndarray) -> list[bytes]:
    """Fingerprints as bytes: 8 for the whole text, 2 a bin."""
    raw = np.concatenate((whole.astype(">u8").view(np.uint8).reshape(-1, 8), bins.astype(">u2").view(np.uint8).reshape(len(bins), -1)), axis=1)
    return [x.tobytes() for x in raw]


def read_bins(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint[16:]), ">u2").astype(np.uint16)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars and fingerprint of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _chunks(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())):
                bins, whole, _, _ = sketches(texts)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([x.hex() for x in packed(bins, whole)])], ["doc_id", "n_chars", "fingerprint"])

    return two_columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _chunks(rows) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for doc_id, text in rows:
        if texts and size + len(text) > AT_ONCE:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(doc_id)
        texts.append(text)
        size += len(text)
    if texts:
        yield ids, texts


def _compared(ids: list, texts: list[str], following: str) -> list[pa.Array]:
    """The columns of RESULT for ``texts``, each of which the next one follows; ``following`` comes after the last."""
    n = len(texts)
    edited = [t[: len(t) - len(t) // 2] + x[: len(t) // 2] for t, x in zip(texts, [*texts[1:], following])]
    bins, whole, hashes, begin = sketches([*texts, following, *edited])
    lengths = np.diff(begin)
    common = hashes.common(begin[:n], begin[n + 1 : -1], np.minimum(lengths[:n], lengths[n + 1 :]))
    return [
        pa.array(ids, pa.int64()),
        pa.array(lengths[:n]),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in edited], pa.binary()),
        pa.array(packed(bins[:n], whole[:n]), pa.binary()),
        pa.array(packed(bins[n + 1 :], whole[n + 1 :]), pa.binary()),
        pa.array(likeness(bins[:n], bins[n + 1 :])),
        pa.array(likeness(bins[:n], bins[1 : n + 1])),
        pa.array(common),
    ]


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()

    def results(ids: list, texts: list[str], following: str) -> pa.RecordBatch:
        columns = _compared(ids, texts, following)
        return pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(ids), pa.int32()), pa.array([ROW] * len(ids), pa.int32()), pa.nulls(len(ids), pa.string())], _names(_PASSED))

    def edge(doc_id: int | None, text: str, role: int) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([doc_id, *[None] * 7, part, role, text], kinds)], _names(_PASSED))

    rows = (row for batch in batches for row in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()))
    held: tuple[list, list[str]] | None = None
    for ids, texts in _chunks(rows):
        if held is None:
            yield edge(ids[0], texts[0], HEAD)
        else:
            yield results(*held, texts[0])
        held = ids, texts
    if held is not None:
        ids, texts = held
        if len(ids) > 1:
            yield results(ids[:-1], texts[:-1], texts[-1])
        yield edge(ids[-1], texts[-1], TAIL)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, text, following in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following"))):
            yield pa.RecordBatch.from_arrays(_compared([doc_id], [text], following), _names(RESULT))


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, common_prefix (of text and edited text).

    Documents are range-partitioned by falling doc_id, so the next one is the next row; only the last
    document of each partition meets the first of the next partition in a join of that many rows.
    """
    spark = docs.sparkSession
    rows = two_columns(docs, id_col, text_col)
    order = [F.desc_nulls_last("doc_id"), F.asc("text")]
    rows = rows.repartitionByRange(partitions(rows), order[0]).sortWithinPartitions(*order)
    passed = written(rows.mapInArrow(_passing, _PASSED), "neighbours")
    parts = sorted(r["part"] for r in passed.where(f"role = {HEAD}").select("part").collect())  # one number a partition
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    heads = passed.where(f"role = {HEAD}").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    tails = passed.where(f"role = {TAIL}").select("doc_id", "text", "part").join(F.broadcast(after), "part").join(heads, "next_part")
    ends = tails.select("doc_id", "text", "following").mapInArrow(_ends, RESULT)
    out = passed.where(f"role = {ROW}").select(_names(RESULT)).unionByName(ends)
    return out.select(*(F.lower(F.hex(c)).alias(c) if kind == "binary" else F.col(c) for c, kind in out.dtypes))
