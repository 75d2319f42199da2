"""Language-model scores of texts: prediction by partial matching over bytes, and a word base beside it.

Both models are learned from every text outside the held-out fold. All their counts are exact and stay
distributed: keys (a context with its byte, or a word's hash) are counted in each task and meet by
buckets, and the merged buckets are a written table that grows with the corpus. The trie's bucket
holds whole nodes from order ``ppm.LOW`` + 1 up; the orders below are at most 2^24 entries and every task has them.

Texts are scored in two steps. What is frequent (at most ``GRAMS`` contexts with their byte, and
``WORDS`` words, by count) is answered where the text is read; every other key goes to its bucket,
where the trie gives its probability, escapes included, and the answers are summed by row. A bucket with many
requests is split among tasks that each read its part of the trie. Where the limit lies changes no result.

Defined cases: a null text is empty, and an empty one is its end alone; rows with a null identifier are
learned from; repeated rows are learned from and scored each; with nothing to learn from the base gives each
token 1 and the model each byte the same share; an empty table gives an empty one; columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.tables import collecting, forget

from . import ppm
from .common import partitions, two_columns, written
from .key_sets import distinct, numbers, packed_keys, planes, summed, unpacked_keys
from .word_spans import Words, word_spans
from .words import LOWER, SEPARATOR, mix, span_hashes

#: Of so many folds, rows of this one are scored only.
FOLDS, HELD_OUT = 5, 1
#: Frequent keys that every task holds (under 50 MB in all).
GRAMS, WORDS = 1 << 21, 1 << 20
#: Buckets of either kind of key; keys that a task gathers before it sends them; requests that one task answers of a bucket.
BUCKETS, GATHERED, ANSWERED = 1024, 1 << 21, 1 << 24
#: Kinds of keys.
GRAM, WORD = 0, 1
_MODEL = "kind int, bucket int, n int, keys binary, counts binary"
_NAMES = ["kind", "bucket", "n", "keys", "counts"]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _bucket(kind: int, keys: np.ndarray) -> np.ndarray:
    """Contexts that share their nearest bytes above the low orders lie in one bucket."""
    own = keys >> np.uint64(8 * (ppm.ORDER - ppm.LOW)) if kind == GRAM else keys
    return (mix(own) % np.uint64(BUCKETS)).astype(np.int64)


def _stream(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that the model sees of each text in a row, and where each text begins."""
    joined = words.joined(np.ones(len(words.start), bool))
    ends = np.frombuffer(joined.buffers()[1], "<i8")[: len(joined) + 1]
    begin = ends + np.arange(len(ends))
    out = np.full(begin[-1], 10, np.uint8)
    inner = np.ones(len(out), bool)
    inner[begin[1:] - 1] = False
    out[inner] = np.frombuffer(joined.buffers()[2] or b"", np.uint8)[: ends[-1]]
    return out, begin


def _word_keys(words: Words) -> np.ndarray:
    padded = np.concatenate((words.data, np.zeros(8, np.uint8)))
    return span_hashes(padded, words.start, words.end)[0]


def _by_bucket(kind: int, keys: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, np.ndarray, tuple[np.ndarray, ...]]]:
    """Sorted keys, and what belongs to them, bucket by bucket."""
    bucket = _bucket(kind, keys)
    order = np.argsort(bucket.astype(np.uint16), kind="stable")
    bucket = bucket[order]
    at = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(keys))
    for a, b in zip(at[:-1], at[1:]):
        yield int(bucket[a]), keys[order[a:b]], tuple(c[order[a:b]] for c in columns)


def _record(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names)


_MODEL_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]


def _counted(texts: DataFrame) -> DataFrame:
    """The keys of all texts and how often they occur, merged by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

        def sent(kind: int) -> Iterator[pa.RecordBatch]:
            keys, n = held[kind][0]
            rows = [(kind, b, len(k), packed_keys(k), planes(c)) for b, k, (c,) in _by_bucket(kind, keys, n)]
            for a in range(0, len(rows), 64):
                yield _record(rows[a : a + 64], _NAMES, _MODEL_TYPES)

        def merged(kind: int) -> None:
            held[kind] = [summed(np.concatenate([k for k, _ in held[kind]]), np.concatenate([n for _, n in held[kind]]))]

        for batch in batches:
            for words in word_spans(batch.column("text"), SEPARATOR, LOWER):
                for kind, keys in ((GRAM, ppm.grams(*_stream(words))), (WORD, _word_keys(words))):
                    own, at = distinct(keys)
                    held[kind].append((own, np.bincount(at, minlength=len(own))))
                    if sum(len(k) for k, _ in held[kind]) >= 2 * GATHERED:
                        merged(kind)
                        if len(held[kind][0][0]) >= GATHERED:
                            yield from sent(kind)
                            held[kind] = []
        for kind in (GRAM, WORD):
            if held[kind]:
                merged(kind)
                yield from sent(kind)

    made = texts.select("text").mapInArrow(count, _MODEL).repartition(partitions(texts), "kind", "bucket").sortWithinPartitions("kind", "bucket")
    return written(made.mapInArrow(_merged, _MODEL), "model")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a bucket from rows in order of their buckets."""
    now, keys, counts, size = None, [], [], 0

    def made() -> pa.RecordBatch:
        k, c = summed(np.concatenate(keys), np.concatenate(counts))
        return _record([(*now, len(k), packed_keys(k), planes(c))], _NAMES, _MODEL_TYPES)

    for batch in batches:
        for kind, bucket, n, k, c in zip(*(column.to_pylist() for column in batch.columns)):
            if (kind, bucket) != now and keys:
                yield made()
                keys, counts, size = [], [], 0
            now = (kind, bucket)
            keys.append(unpacked_keys(k, n))
            counts.append(numbers(c, n).astype(np.int64))
            size += n
            if size >= 4 * GATHERED:
                some = summed(np.concatenate(keys), np.concatenate(counts))
                keys, counts, size = [some[0]], [some[1]], len(some[0])
    if keys:
        yield made()


def _entries(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for kind, bucket, n, k, c in zip(*(batch.column(c).to_pylist() for c in _NAMES)):
        yield kind, bucket, unpacked_keys(k, n), numbers(c, n).astype(np.int64)


def _low(model: DataFrame) -> dict[int, ppm.Level]:
    """The nodes of order ``ppm.LOW`` and below, from the buckets' entries: at most 2^24 of them."""

    def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, keys, _ in _entries(batch):
                for k in range(ppm.ORDER, ppm.LOW, -1):
                    keys, n = ppm.shortened(keys, k)
                rows = []
                near = keys >> np.uint64(8 * ppm.LOW)  # the nearest byte
                at = np.append(np.flatnonzero(np.concatenate((np.ones(min(len(near), 1), bool), near[1:] != near[:-1]))), len(near))
                rows = [(GRAM, int(near[a]), int(b - a), packed_keys(keys[a:b]), planes(n[a:b])) for a, b in zip(at[:-1], at[1:])]
                yield _record(rows, _NAMES, _MODEL_TYPES)

    rows = model.where(F.col("kind") == GRAM).mapInArrow(shortened, _MODEL)
    table = rows.repartition(partitions(model), "kind", "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(_merged, _MODEL).toArrow()
    parts = [(k, n) for batch in table.to_batches() for _, _, k, n in _entries(batch)]
    keys, n = summed(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return ppm.levels(keys, n, ppm.LOW, 0, None)


def _frequent(model: DataFrame, kind: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent keys, at most so many, sorted; and of each the count of a word, or the natural logarithm of a byte's probability."""

    def bins(counts: np.ndarray) -> np.ndarray:
        return np.floor(8 * np.log2(counts)).astype(np.int64)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, n in _entries(batch):
                bin_, times = np.unique(bins(n), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(bin_), pa.array(times)], ["bin", "times"])

    own = model.where(F.col("kind") == kind)
    often, least = 0, 1 << 30
    for r in own.mapInArrow(tally, "bin long, times long").groupBy("bin").agg(F.sum("times").alias("times")).orderBy(F.desc("bin")).collect():  # 512 rows at most
        often += r["times"]
        if often > most:
            break
        least = r["bin"]

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, keys, n in _entries(batch):
                value = n.astype(float)
                if kind == GRAM:
                    value = ppm.log_probabilities_of_seen(keys, n)
                some = bins(n) >= least
                yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(value[some])], ["key", "value"])

    table = own.mapInArrow(chosen, "key long, value double").toArrow()
    keys = table["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], table["value"].to_numpy()[order]


@dataclass
class Frequent:
    """What every task holds."""

    keys: tuple[np.ndarray, np.ndarray]
    values: tuple[np.ndarray, np.ndarray]

    def look_up(self, kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are frequent, and the values of these (0 for others)."""
        known = self.keys[kind]
        if not len(known):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        order = np.argsort(keys)  # in order, a search runs through memory once
        at = np.empty(len(keys), np.int64)
        at[order] = np.minimum(np.searchsorted(known, keys[order]), len(known) - 1)
        found = known[at] == keys
        return found, np.where(found, self.values[kind][at], 0.0)


def _listed(text: np.ndarray, keys: np.ndarray, n_texts: int) -> tuple[pa.Array, pa.Array]:
    """The keys of each text and how often it has them, as lists."""
    order = np.lexsort((keys, text))
    text, keys = text[order], keys[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), (keys[1:] != keys[:-1]) | (text[1:] != text[:-1]))))
    count = np.diff(np.append(first, len(keys)))
    ends = pa.array(np.searchsorted(text[first], np.arange(n_texts + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(keys[first].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(count))


_READ = "doc_id long, row long, n_tokens long, n_known long, base double, score double, grams array<long>, gram_n array<long>, words array<long>, word_n array<long>"


def _read(texts: DataFrame, frequent: Frequent) -> DataFrame:
    """Each row's sums over its frequent keys, and its other keys with their counts."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for words in word_spans(batch.column("text"), SEPARATOR, LOWER):
                n_texts = words.last - words.first
                data, begin = _stream(words)
                parts = []
                for kind, keys, ends in ((GRAM, ppm.grams(data, begin), begin), (WORD, _word_keys(words), words.begin)):
                    own, at = distinct(keys)
                    found, value = shared.value.look_up(kind, own)
                    if kind == WORD:
                        value = np.where(found, np.log10(value + 0.5), 0.0)
                    text = np.repeat(np.arange(n_texts), np.diff(ends))
                    rare = np.flatnonzero(~found[at])
                    parts.append((np.bincount(text, value[at], n_texts), np.bincount(text, found[at], n_texts).astype(np.int64), *_listed(text[rare], keys[rare], n_texts)))
                (score, _, grams, gram_n), (base, known, rare_words, word_n) = parts
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(words.first, n_texts), pa.array(row + np.arange(n_texts)), pa.array(np.diff(words.begin)), pa.array(known), pa.array(base), pa.array(score), grams, gram_n, rare_words, word_n], [c.split(" ")[0] for c in _READ.split(", ")])
                row += n_texts

    return written(texts.mapInArrow(run, _READ), "read")


_REQUEST = "kind int, bucket int, asked long, n int, keys binary, counts binary, who binary"


def _requests(read: DataFrame) -> DataFrame:
    """The keys that are not frequent, with their rows, by bucket; ``asked`` is how many there are."""
    names = [c.split(" ")[0] for c in _REQUEST.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, ...]]] = [[], []]

        def sent(kind: int) -> Iterator[pa.RecordBatch]:
            keys, counts, who = (np.concatenate(c) for c in zip(*held[kind]))
            order = np.argsort(keys, kind="stable")
            rows = [(kind, b, len(k), len(k), packed_keys(k), planes(c), planes(w)) for b, k, (c, w) in _by_bucket(kind, keys[order], counts[order], who[order])]
            for a in range(0, len(rows), 64):
                yield _record(rows[a : a + 64], names, types)
            held[kind] = []

        for batch in batches:
            row = batch.column("row").to_numpy()
            for kind, keys, counts in ((GRAM, "grams", "gram_n"), (WORD, "words", "word_n")):
                listed = batch.column(keys)
                held[kind].append((listed.flatten().to_numpy().view(np.uint64), batch.column(counts).flatten().to_numpy(), np.repeat(row, np.diff(listed.offsets.to_numpy()))))
                if sum(len(k) for k, *_ in held[kind]) >= GATHERED:
                    yield from sent(kind)
        for kind in (GRAM, WORD):
            if sum(len(k) for k, *_ in held[kind]):
                yield from sent(kind)

    return written(read.select("row", "grams", "gram_n", "words", "word_n").mapInArrow(run, _REQUEST), "requests")


def _answered(model: DataFrame, requests: DataFrame, low: dict[int, ppm.Level]) -> DataFrame:
    """row, known, base, score: what each row's rarer keys come to."""
    ways = requests.groupBy("kind", "bucket").agg(F.sum("asked").alias("asked")).select("kind", "bucket", F.ceil(F.col("asked") / ANSWERED).cast("int").alias("ways"))  # a row a bucket
    ways = F.broadcast(ways)
    trie = model.join(ways, ["kind", "bucket"]).select("kind", "bucket", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("way"), "n", "keys", "counts", F.lit(None).cast("binary").alias("who"))
    asking = requests.join(ways, ["kind", "bucket"]).select("kind", "bucket", F.pmod(F.xxhash64("who"), F.col("ways")).cast("int").alias("way"), "n", "keys", "counts", "who")
    shared = model.sparkSession.sparkContext.broadcast(low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, counts, nodes = None, np.zeros(0, np.uint64), np.zeros(0, np.int64), None
        for batch in batches:
            for kind, bucket, n, k, c, w in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "n", "keys", "counts", "who"))):
                if (kind, bucket) != now:
                    now, keys, counts, nodes = (kind, bucket), np.zeros(0, np.uint64), np.zeros(0, np.int64), None
                if w is None:
                    keys, counts = unpacked_keys(k, n), numbers(c, n).astype(np.int64)
                    continue
                asked, times, who = unpacked_keys(k, n), numbers(c, n).astype(np.int64), numbers(w, n).astype(np.int64)
                own, at = np.unique(asked, return_inverse=True)
                if kind == GRAM:
                    if nodes is None:
                        nodes = {**shared.value, **ppm.levels(keys, counts, ppm.ORDER, ppm.LOW + 1, shared.value[ppm.LOW])}
                    score, base, known = ppm.log_probabilities(own, nodes)[at] * times, np.zeros(n), np.zeros(n)
                else:
                    place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    c = np.where(keys[place] == own, counts[place], 0)[at] if len(keys) else np.zeros(n)
                    score, base, known = np.zeros(n), np.log10(c + 0.5) * times, (c > 0) * times
                row, at = np.unique(who, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.bincount(at, known, len(row)).astype(np.int64)), pa.array(np.bincount(at, base, len(row))), pa.array(np.bincount(at, score, len(row)))], ["row", "known", "base", "score"])

    # A bucket's trie comes before its requests.
    rows = trie.unionByName(asking).repartition(partitions(model), "kind", "bucket", "way").sortWithinPartitions("kind", "bucket", "way", F.col("who").isNotNull())
    answers = rows.mapInArrow(run, "row long, known long, base double, score double")
    return answers.groupBy("row").agg(F.sum("known").alias("more_known"), F.sum("base").alias("more_base"), F.sum("score").alias("more_score"))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (log10 of the word base), score (log10 of the model's probability) and n_bytes of the model's text, of each row."""
    texts = two_columns(docs, id_col, text_col)
    spark: SparkSession = docs.sparkSession
    model = _counted(texts.where(~held_out(F.col("doc_id"))))
    n_words, n_distinct = _word_sums(model)
    n_train = texts.where(~held_out(F.col("doc_id"))).count()
    low = _low(model)
    frequent = Frequent(*zip(_frequent(model, GRAM, GRAMS), _frequent(model, WORD, WORDS)))
    read = _read(texts, frequent)
    with collecting() as made:
        answers = written(_answered(model, _requests(read), low), "answers")
    forget(spark, made, but=[answers])
    total, vocabulary = n_words + n_train, n_distinct + (n_train > 0)
    scale = float(np.log10(total + 0.5 * (vocabulary + 1)))
    rows = read.drop("grams", "gram_n", "words", "word_n").join(answers, "row", "left").fillna(0, ["more_known", "more_base", "more_score"])
    tokens = F.col("n_tokens") + 1
    return rows.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        tokens.alias("n_tokens"),
        (F.col("n_known") + F.col("more_known") + int(n_train > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more_base") + float(np.log10(n_train + 0.5)) - tokens * scale).alias("base_score"),
        ((F.col("score") + F.col("more_score")) / float(np.log(10))).alias("score"),
    )


def _word_sums(model: DataFrame) -> tuple[int, int]:
    """Words in all and distinct words that are learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [(int(c.sum()), len(c)) for _, _, _, c in _entries(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in n], pa.int64()), pa.array([x for _, x in n], pa.int64())], ["words", "distinct"])

    row = model.where(F.col("kind") == WORD).mapInArrow(run, "words long, distinct long").agg(F.sum("words").alias("words"), F.sum("distinct").alias("distinct")).first()
    return int(row["words"] or 0), int(row["distinct"] or 0)
