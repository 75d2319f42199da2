"""Exact BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a pre-token the last token of its encoding is unique. An Aho-Corasick automaton
over the vocabulary (in place of a suffix automaton) lists the tokens that end at each byte; the one that is compatible
with the last token of the prefix before it is stored, and the back-pointers give the ids.
Two tokens are compatible when no merge may join the right edge of the first to the left edge
of the second before either edge is itself merged further.

Defined cases: a null text is empty; an empty text has no ids and decodes to the empty text;
repeated rows are encoded row by row; an empty table gives an empty one; columns other than the
two named are not read; special strings in a text become their special tokens.
"""

from __future__ import annotations

import hashlib
import struct
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bytebpe
from .common import two_columns
from .library_ids import RunIds

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_NEVER = 1 << 60
#: Pairs of tokens whose compatibility a worker remembers.
PAIRS_KEPT = 1_000_000


class Codec:
    """Encodes and decodes whole texts under one vocabulary."""

    def __init__(self, path: str):
        self.vocabulary = v = bytebpe.vocabulary(path)
        self.automaton = ahocorasick.Automaton()
        for i, raw in v.bytes_of.items():
            if i not in v.special.values() and v.merge(raw) == [i]:
                self.automaton.add_word(raw.decode("latin-1"), (len(raw), i))
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.runs = RunIds(True, list(v.special), lambda latin: self.word(latin.decode("latin-1")), self.whole)
        self.token_bytes = pa.array([v.bytes_of.get(i, b"") for i in range(max(v.bytes_of) + 1)], pa.large_binary())

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """(token, rank at which it is merged further) down one edge of a token: side 1 is the right edge, 0 the left."""
        v, out, until = self.vocabulary, [], _NEVER
        while True:
            out.append((token, until))
            if token not in v.parts:
                return out
            token, until = v.parts[token][side], v.rank[token]

    def joins(self, first: int, second: int) -> bool:
        """Whether both tokens stay as they are side by side."""
        merges = self.vocabulary.merges
        right, left = self.edge(first, 1), self.edge(second, 0)
        for a, a_until in right:
            for b, b_until in left:
                # A merge of the rank that ends a is the one that made a's parent, further left: it goes first.
                if (m := merges.get((a, b))) and m[0] < a_until and m[0] <= b_until:
                    return False
        return True

    def prefixes(self, raw: bytes) -> list[int]:
        n = len(raw)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        known = self.compatible
        for end, (length, token) in self.automaton.iter(raw.decode("latin-1")):
            end += 1
            if size[end]:
                continue
            begin = end - length
            if begin:
                before = last[begin]
                if before < 0:
                    continue
                fits = known.get((before, token))
                if fits is None:
                    if len(known) >= PAIRS_KEPT:
                        known.clear()
                    fits = known[before, token] = self.joins(before, token)
                if not fits:
                    continue
            last[end], size[end] = token, length
        out = []
        while n:
            if not size[n]:
                raise ValueError(f"the vocabulary has no tokens for {raw!r}")
            out.append(last[n])
            n -= size[n]
        out.reverse()
        return out

    def word(self, word: str) -> bytes:
        return array("I", self.prefixes(word.encode("utf-8"))).tobytes()

    def whole(self, text: str) -> bytes:
        return b"".join(b"".join(map(self.word, bytebpe.split(part))) + (b"" if special is None else struct.pack("<I", special)) for part, special in self.vocabulary.between_specials(text))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.runs(text)

    def decode(self, ids: bytes) -> str:
        return self.decoded(np.frombuffer(ids, "<u4"), np.array([len(ids) // 4]))[0].decode("utf-8", errors="replace")

    def decoded(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of runs of ids that end at ``ends``."""
        found = self.token_bytes.take(pa.array(ids))
        upto = np.frombuffer(found.buffers()[1], "<i8")[: len(ids) + 1][np.append(0, ends)].tolist()
        raw = found.buffers()[2].to_pybytes() if upto[-1] else b""
        return [raw[a:b] for a, b in zip(upto, upto[1:])]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs.clear()
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit integers) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or bytebpe.tokenizer_path("byte_bpe_50k.json"))
        for batch in batches:
            encoded = [ids[a:b].tobytes() for _, _, ids, ends in c.runs.batches(batch.column("text")) for a, b in zip(np.append(0, ends), ends)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(encoded, pa.binary())], ["doc_id", "ids"])

    return two_columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each row of ids; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or bytebpe.tokenizer_path("byte_bpe_50k.json"))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([c.decode(x or b"") for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{ids_col}` ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row encoded and decoded again: doc_id, n_tokens, SHA-256 of the ids and of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sha = codec(path or bytebpe.tokenizer_path("byte_bpe_50k.json")), hashlib.sha256
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for _, _, ids, ends in c.runs.batches(batch.column("text")):
                raw, upto = ids.tobytes(), np.append(0, ends).tolist()
                n += np.diff(upto).tolist()
                ids_sha += [sha(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(upto, upto[1:])]
                text_sha += [sha(x.decode("utf-8", errors="replace").encode("utf-8")).hexdigest() for x in c.decoded(ids, ends)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return two_columns(docs, id_col, text_col).mapInArrow(run, SCHEMA)
