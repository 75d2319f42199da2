"""Quality by histogram gradient-boosted trees over document statistics.

The statistics are shares of byte classes, lengths, and how much a text repeats its words and
pairs of words; they come from whole texts, vectorised over runs of documents. The trees are learned
from at most ``EACH`` labelled rows of either class outside the held-out fold, weighted to the
classes' true shares, and walked as flat arrays. Only the text is an input of a score.

Defined cases: a null text is empty, and empty texts score by their all-zero statistics; a table
without labels of both classes scores 0 everywhere; null labels are left aside; rows that repeat
are scored alike; an empty table gives an empty one; columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trees
from .common import two_columns
from .labelled import held_out, sample
from .words import column_words, mix

#: Labelled rows of either class that are learned from at most.
EACH = 4000
_PAIR = np.uint64(0x9E3779B97F4A7C15)
#: Byte classes: lower, upper, digit, space, line end, . , ! ? | quote, bracket, symbol, other control, beyond ASCII.
CLASSES = 14
_CLASS = np.full(256, 12, np.int64)
_CLASS[128:] = 13
_CLASS[33:127] = 11
for _k, _set in enumerate((range(97, 123), range(65, 91), range(48, 58), b" ", b"\n\r", b".", b",", b"!", b"?", b"|", b"\"'()[]{}")):
    _CLASS[list(_set)] = _k
STATISTICS = CLASSES + 9


def statistics(column: pa.Array) -> np.ndarray:
    """One row of document statistics for each text of a column without nulls."""
    out = np.zeros((len(column), STATISTICS))
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], "<i8")[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    for i, j, words, begin in column_words(column):
        sizes = np.diff(offsets[i : j + 1])
        owner = np.repeat(np.arange(j - i), sizes)
        kinds = np.bincount(owner * CLASSES + _CLASS[data[offsets[i] : offsets[j]]], minlength=(j - i) * CLASSES).reshape(j - i, CLASSES)
        x = out[i:j]
        x[:, :CLASSES] = kinds / np.maximum(sizes, 1)[:, None]
        n = np.diff(begin)
        some = np.maximum(n, 1)
        x[:, CLASSES] = np.log1p(sizes)
        x[:, CLASSES + 1] = (sizes - kinds[:, 3] - kinds[:, 4]) / some
        x[:, CLASSES + 2] = np.log1p(sizes / (kinds[:, 4] + 1))
        of_word = np.repeat(np.arange(j - i), n)
        same = np.zeros(len(words), bool)
        same[1:] = (words[1:] == words[:-1]) & (of_word[1:] == of_word[:-1])
        x[:, CLASSES + 3] = np.bincount(of_word, same, minlength=j - i) / some
        distinct, top, share = _repeats(words, of_word, j - i)
        x[:, CLASSES + 4], x[:, CLASSES + 5] = distinct / some, top / some
        pairs = mix(words[1:] * _PAIR + words[:-1])
        inside = of_word[1:] == of_word[:-1]
        distinct, top, share = _repeats(pairs[inside], of_word[1:][inside], j - i)
        x[:, CLASSES + 6], x[:, CLASSES + 7], x[:, CLASSES + 8] = distinct / np.maximum(n - 1, 1), top / np.maximum(n - 1, 1), share / np.maximum(n - 1, 1)
    return out


def _repeats(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per owner: distinct values, the count of the most frequent, and how many occur again."""
    if not len(values):
        return np.zeros(n), np.zeros(n), np.zeros(n)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], (values[1:] != values[:-1]) | (owner[1:] != owner[:-1]))))
    count = np.diff(np.append(first, len(values)))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner[first], count)
    return np.bincount(owner[first], minlength=n), top, np.bincount(owner[first], count * (count > 1), minlength=n)


def learn(texts: list[str], good: list[int], counts: dict[int, int]) -> trees.Trees | None:
    """Trees, or none without texts of both classes."""
    y = np.array(good, float)
    if len(set(good)) < 2:
        return None
    share = np.array([counts[c] / max((y == c).sum(), 1) for c in (0, 1)])
    weight = share[y.astype(int)]
    return trees.train(statistics(pa.array(texts, pa.string())), y, weight / weight.mean())


def quality(docs: DataFrame, labels: DataFrame, each: int = EACH, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= ``threshold``) of each row; ``labels`` has doc_id and quality."""
    model = docs.sparkSession.sparkContext.broadcast(learn(*sample(docs, labels, "quality", each, id_col, text_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.value.probability(statistics(batch.column("text"))) if model.value is not None else np.zeros(len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    scored = two_columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
