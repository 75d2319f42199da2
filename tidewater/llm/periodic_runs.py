"""Periodic runs of words on a harmonic grid, by prefix hashes.

For each period p the grid points are the multiples of p in a text; a run of period p and at least
2p words holds two neighbouring ones. From each pair of neighbours with equal words, all of a run
of texts and all periods at once, the longest common extensions to the left and to the right are
found by binary search over prefix hashes. A text of n words has n/1 + n/2 + ... such pairs. Pairs that
lie in a run which an earlier pair of that period reaches go; so do periods that are multiples of a
stretch's smallest one, as both give the same stretch. The words of every run found are compared; where hashes met by
chance, the extension is worked out from the words.

A run is a stretch of consecutive words with smallest period q and a length of at least
max(``least``, 2q) that no neighbouring word extends keeping that period.

Defined cases: a null or empty text, or one without words, has no runs and collapses to the empty
text; texts of any length are read whole; repeated rows are searched row by row; an empty table
gives an empty one; columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import two_columns
from .prefix_hash import PrefixHash
from .word_spans import word_spans
from .words import SEPARATOR

#: Words a run has at least; pairs of grid points that are looked at together.
LEAST, PAIRS = 12, 1 << 20
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _grid(begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Grid points, their periods, and where their texts begin and end, for all periods of all texts, so many pairs at once."""
    size = np.diff(begin)
    half = size // 2
    text = np.repeat(np.arange(len(size)), half)
    period = np.arange(len(text)) - np.repeat(np.cumsum(half) - half, half) + 1
    upto = np.concatenate(([0], np.cumsum((size[text] - 1) // period)))
    for a in range(0, int(upto[-1]), PAIRS):
        b = min(a + PAIRS, int(upto[-1]))
        lo, hi = int(np.searchsorted(upto, a, side="right")) - 1, int(np.searchsorted(upto, b))
        count = np.minimum(upto[lo + 1 : hi + 1], b) - np.maximum(upto[lo:hi], a)
        row = np.repeat(np.arange(lo, hi), count)
        p, t = period[row], text[row]
        yield begin[t] + (np.arange(a, b) - upto[row]) * p, p, begin[t], begin[t + 1]


def _common_left(hashed: PrefixHash, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Longest common extension to the left of each pair of places (these not included), up to ``most``."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    while (open_ := low < high).any():
        mid = np.where(open_, (low + high + 1) // 2, low)
        same = hashed.spans(a - mid, a) == hashed.spans(b - mid, b)
        low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
    return low


def _periodic(codes: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether each stretch has its period, word by word."""
    out = np.ones(len(start), bool)
    size = end - start - period
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), PAIRS, side="right")) + at)
        own = size[at:stop]
        upto = np.cumsum(own) - own
        place = np.arange(own.sum()) - np.repeat(upto, own) + np.repeat(start[at:stop], own)
        out[at:stop] = np.logical_and.reduceat(codes[place] == codes[place + np.repeat(period[at:stop], own)], upto)
        at = stop
    return out


def _by_words(codes: np.ndarray, i: int, p: int, begin: int, end: int) -> tuple[int, int]:
    """The stretch of period p around the equal words i and i + p of a text."""
    same = codes[begin : end - p] == codes[begin + p : end]
    left, right = np.flatnonzero(~same[: i - begin]), np.flatnonzero(~same[i - begin :])
    return begin + (int(left[-1]) + 1 if len(left) else 0), (i + int(right[0]) if len(right) else end - p) + p


def runs(codes: np.ndarray, begin: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period) of all runs of all texts in a row of word codes, by start, then period; text t has the places ``begin[t]`` to ``begin[t + 1]``."""
    hashed, found = PrefixHash(codes.astype(np.uint32)), [np.zeros((0, 6), np.int64)]
    for i, p, first, last in _grid(begin):
        some = np.flatnonzero((codes[i] == codes[i + p]) & (last - first >= least))
        i, p, first, last = i[some], p[some], first[some], last[some]
        left = _common_left(hashed, i, i + p, np.minimum(i - first, p))
        some = np.flatnonzero(left < p)  # otherwise the grid point before lies in the same stretch
        i, p, first, last, left = i[some], p[some], first[some], last[some], left[some]
        right = hashed.common(i, i + p, last - i - p)
        some = np.flatnonzero((left + right >= p) & (left + right + p >= least))
        found.append(np.stack([x[some] for x in (i - left, i + p + right, p, i, first, last)], 1))
    rows = np.concatenate(found)
    rows = _smallest(rows)
    for k in np.flatnonzero(~_periodic(codes, *rows[:, :3].T)).tolist() if len(rows) else ():
        rows[k, :2] = _by_words(codes, *rows[k, [3, 2, 4, 5]].tolist())
    rows = rows[rows[:, 1] - rows[:, 0] >= np.maximum(least, 2 * rows[:, 2])]
    return _smallest(rows)[:, :3]


def _smallest(rows: np.ndarray) -> np.ndarray:
    """Of the rows of one stretch that with the smallest period; by start, then period."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    rows = rows[np.concatenate((np.ones(min(len(rows), 1), bool), (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _after_first(found: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in a run after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, found[:, 0] + found[:, 2], 1)
    np.add.at(edges, found[:, 1], -1)
    return np.cumsum(edges)[:n] > 0


def find_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed (the words that no run repeats after its first period, joined by one space) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in word_spans(batch.column("text"), SEPARATOR):
                begin = words.begin
                found = runs(words.coded()[0], begin, least)
                text = np.searchsorted(begin, found[:, 0], side="right") - 1
                numbers = [found[:, 0] - begin[text], found[:, 1] - found[:, 0], found[:, 2]]
                listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(begin))).astype(np.int32)), pa.StructArray.from_arrays([pa.array(x) for x in numbers], ["start", "length", "period"]))
                collapsed = words.joined(~_after_first(found, len(words.start)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(words.first, words.last - words.first), pa.array(np.diff(begin)), listed, collapsed.cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return two_columns(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text; a tenth of the texts, by the identifier's crc32, repeat a stretch of their words to the end. A null identifier's text stays as it is, and so does one without words."""
    rows = two_columns(docs, id_col, text_col)
    h = "crc32(cast(cast(doc_id as string) as binary))"
    # An array of one binds what is used several times, so that it is worked out once.
    words = r"array(filter(split(text, '[\\x20\\x09-\\x0D]+', -1), w -> w <> ''))"
    sizes = f"transform({words}, w -> struct(w, size(w) as n, {h} div 10 as g))"
    places = f"transform(filter({sizes}, x -> x.n > 0), x -> struct(x.w, x.n, cast(x.g % x.n as int) as a, 1 + cast((x.n - x.g % x.n) div (3 + x.g % 8) as int) as p))"
    edited = f"transform({places}, x -> array_join(transform(sequence(0, x.n - 1), i -> x.w[if(i < x.a, i, x.a + (i - x.a) % x.p)]), ' '))"
    return rows.select("doc_id", F.expr(f"case when {h} % 10 = 0 then coalesce(get({edited}, 0), text) else text end").alias("text"))


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of the texts after planting: doc_id, n_runs, the longest run (ties: smallest start, then period), digests of all runs and of the collapsed text."""
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    rows = find_runs(with_planted_runs(docs, id_col, text_col)).select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.selectExpr("doc_id", "n_runs", "-best.start as start", "best.length as length", "-best.period as period", "(1000 * best.length) div -best.period as exponent_milli", "runs_sha256", "collapsed_sha256")
