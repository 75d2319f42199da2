"""Token counts by the whole-token shortcut.

Offline, every vocabulary string that encodes alone as one token is proven to do so
(``Vocabulary.alone``). A pre-token among them counts one; only the rest is merged.
Each distinct word of a run of texts is looked at once; what it came to is remembered, within a bound, in each worker.

Defined cases: a null text is empty; an empty text has 0 bytes and 0 tokens; rows that are
repeated or tie are counted row by row; an empty table gives an empty one; columns other than
the two named are not read. A text of any length is counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import bytebpe
from .common import two_columns
from .library_ids import RunIds

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class Counter:
    """Counts tokens of whole texts under one vocabulary."""

    def __init__(self, path: str):
        self.vocabulary = v = bytebpe.vocabulary(path)
        self.runs = RunIds(True, list(v.special), lambda latin: self.tokens(latin.decode("latin-1")), self.whole)

    def tokens(self, word: str) -> bytes:
        """Four bytes for each token of a pre-token."""
        return bytes(4 if word in self.vocabulary.alone else 4 * len(self.vocabulary.merge(word.encode("utf-8"))))

    def whole(self, text: str) -> bytes:
        v = self.vocabulary
        return b"".join(b"".join(map(self.tokens, bytebpe.split(part))) + bytes(4 * (special is not None)) for part, special in v.between_specials(text))

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text of a column without nulls."""
        return np.concatenate([np.zeros(0, np.int64), *(np.diff(ends, prepend=0) for _, _, _, ends in self.runs.batches(texts))])

    def __call__(self, text: str) -> int:
        return int(self.counts(pa.array([text]))[0])


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters.clear()
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row; ``path`` is a byte-level BPE file (default: byte_bpe_50k.json)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path or bytebpe.tokenizer_path("byte_bpe_50k.json"))
        for batch in batches:
            texts = batch.column("text")
            n = pa.array(count.counts(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return two_columns(docs, id_col, text_col).mapInArrow(run, SCHEMA)
