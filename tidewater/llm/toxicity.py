"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models of words (runs of letters, A-Z lower-cased), one of toxic and one of ordinary
labelled texts. Each discounts its bigrams into its own unigrams and those into one continuation
distribution that both classes share: in how many contexts the whole corpus, labelled or not, has
a word. An expression too rare to tell the classes apart backs off to the same probability in both
and speaks for neither. A text's score is its difference of log-likelihoods per word, set against
length by a logistic curve that is fitted on labelled rows the models haven't seen, with the
classes at their true shares.

Class counts and the curve come from all labelled rows outside the held-out fold (equal texts of one class count once),
continuation counts from all documents; every text is scored whole. The labelled rows are in ``PARTS``
parts; for the curve each text is scored by models of the other parts. What reaches the driver and every worker is the vocabulary with its
counts, which grows more slowly than the corpus, and the pairs that tell the classes apart. Only
the text is an input of a score.

Defined cases: a null text is empty; a text without words scores the prior; a table without
labels of both classes scores 0 everywhere; null labels are left aside; rows that repeat are
scored alike; an empty table gives an empty one; columns other than those named are not read.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.tables import collecting, forget

from .common import for_workers, give_back, lean, partitions, two_columns, written
from .labelled import held_out, labelled_ids, sieve
from .words import NO_LETTER, column_words, mix

#: A word is in the vocabulary if so many learned-from texts hold it; the discount of counts.
LEAST_TEXTS, DISCOUNT = 3, 0.75
#: Log-likelihood ratio from which counts tell the classes apart.
EVIDENCE = 11.0
#: Words or pairs of words that a task gathers before it leaves repeated ones out; ranges of words by which pairs meet again, and how many are sent at once.
GATHERED, BUCKETS, SENT = 1 << 22, 2048, 256
#: Parts of the labelled rows: the curve's inputs come from models that leave out a text's own part.
PARTS = 4
_PAIR = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    vocabulary: np.ndarray  # sorted word hashes
    word: np.ndarray  # log P_toxic(w) / P_ordinary(w)
    context: np.ndarray  # log of the back-off weights' ratio after a word
    pairs: np.ndarray  # sorted hashes of seen pairs
    pair: np.ndarray  # what a seen pair adds to the two above
    curve: np.ndarray  # logistic weights of _inputs
    centre: np.ndarray
    scale: np.ndarray

    def ratios(self, words: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Sum of log-likelihood differences of each text."""
        if not len(self.vocabulary) or not len(words):
            return np.zeros(len(begin) - 1)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == words
        value = np.where(known, self.word[at], 0.0)
        after = known[1:] & known[:-1]
        inner = begin[(begin > 0) & (begin < len(words))]
        after[inner - 1] = False
        second = np.flatnonzero(after) + 1
        value[second] += self.context[at[second - 1]]
        if len(self.pairs) and len(second):
            key = mix(words[second - 1] * _PAIR + words[second])
            k = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            value[second] += np.where(self.pairs[k] == key, self.pair[k], 0.0)
        total = np.concatenate(([0.0], np.cumsum(value)))
        return total[begin[1:]] - total[begin[:-1]]

    def scores(self, words: np.ndarray, begin: np.ndarray) -> np.ndarray:
        z = (_inputs(self.ratios(words, begin), np.diff(begin)) - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(z @ self.curve[:-1] + self.curve[-1], -30, 30)))


def _inputs(ratio: np.ndarray, n: np.ndarray) -> np.ndarray:
    n = np.maximum(n, 1)
    return np.stack((np.clip(ratio / n, -0.2, 0.2), np.clip(ratio / np.sqrt(n), -6, 6), np.log1p(np.maximum(ratio, 0)), np.log1p(n)), 1)


def _tells(toxic: np.ndarray, ordinary: np.ndarray, share: np.ndarray | float) -> np.ndarray:
    """Whether counts tell the classes apart: log-likelihood ratio against the toxic share expected."""
    n = toxic + ordinary
    g = 2 * (toxic * np.log(np.maximum(toxic, 1e-9) / np.maximum(n * share, 1e-9)) + ordinary * np.log(np.maximum(ordinary, 1e-9) / np.maximum(n * (1 - share), 1e-9)))
    return g >= EVIDENCE


def _vocabulary(texts: list[np.ndarray]) -> np.ndarray:
    """The words that enough texts hold, sorted."""
    seen, texts_with = np.unique(np.concatenate([np.unique(t) for t in texts] or [np.zeros(0, np.uint64)]), return_counts=True)
    return seen[texts_with >= LEAST_TEXTS]


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers by their lowest, next, ... bytes, as many as the largest needs."""
    wide = values.astype("<u8")
    size = (int(wide.max()).bit_length() + 7) // 8
    return wide.view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _numbers(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(data) // n] = np.frombuffer(data, np.uint8).reshape(-1, n).T
    return out.reshape(-1).view("<u8").astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _split(keys: np.ndarray, counts: np.ndarray, span: int, v: int) -> pa.RecordBatch:
    """Sorted keys and their counts in rows by ranges of words; a word has ``span`` keys. Differences of keys need few bytes."""
    at = np.searchsorted(keys, -(-np.arange(BUCKETS + 1) * v // BUCKETS) * span)  # range k has the words w of w * BUCKETS // v = k
    rows = [(k, int(keys[a]), int(b - a), _planes(np.diff(keys[a:b], prepend=keys[a])), _planes(counts[a:b] - 1)) for k, (a, b) in enumerate(zip(at[:-1], at[1:])) if b > a]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["bucket", "first", "n", "keys", "counts"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys and summed counts of each range of words, from rows in order of their ranges."""
    now, held, keys, counts = None, 0, [], []
    for batch in batches:
        for bucket, first, n, k, c in zip(*(column.to_pylist() for column in batch.columns)):
            if bucket != now and keys:
                yield _summed(np.concatenate(keys), np.concatenate(counts))
                held, keys, counts = 0, [], []
            now = bucket
            keys.append(first + np.cumsum(_numbers(k, n)))
            counts.append(_numbers(c, n) + 1)
            held += n
            if held >= GATHERED:
                some = _summed(np.concatenate(keys), np.concatenate(counts))
                keys, counts, held = [some[0]], [some[1]], 0
    if keys:
        yield _summed(np.concatenate(keys), np.concatenate(counts))


def _met(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], span: int, v: int, counted: bool = True) -> DataFrame:
    """The keys of all rows, distinct and counted (or each counted as one) within each task, in order of their ranges of words."""

    def distinct(keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys.sort()
        first = np.flatnonzero(np.concatenate((np.ones(1, bool), keys[1:] != keys[:-1])))
        made = _split(keys[first], np.diff(first, append=len(keys)) if counted else np.ones_like(first), span, v)
        for at in range(0, len(made), SENT):
            yield made.slice(at, SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.empty(GATHERED, np.int64), 0  # one array, sorted where it lies
        for batch in batches:
            for some in keys_of(batch):
                while len(some):
                    fits = some[: GATHERED - n]
                    keys[n : n + len(fits)] = fits
                    n, some = n + len(fits), some[len(fits) :]
                    if n == GATHERED:
                        yield from distinct(keys)
                        n = 0
        if n:
            yield from distinct(keys[:n])

    made = rows.mapInArrow(lean(run), "bucket int, first long, n int, keys binary, counts binary")
    return made.repartition(partitions(rows), "bucket").sortWithinPartitions("bucket")


def _columns(df: DataFrame) -> list[np.ndarray]:
    table = df.toArrow()
    return [c.to_numpy() for c in table.columns]


def continuations(docs: DataFrame, vocabulary: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """For each word of a vocabulary, in how many contexts all documents have it: after which words of the vocabulary, after any other, at a text's beginning."""
    v = len(vocabulary)
    if not v:
        return np.zeros(0)
    known_words = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        words = known_words.value
        for _, _, w, begin in column_words(batch.column("text"), NO_LETTER):
            if not len(w):
                continue
            at = np.minimum(np.searchsorted(words, w), v - 1)
            known = words[at] == w
            left = np.append(v + 1, np.where(known, at, v)[:-1])
            left[begin[:-1][begin[:-1] < len(w)]] = v + 1
            yield (at * (v + 2) + left)[known]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _ in _merged(batches):
            word, n = np.unique(keys // (v + 2), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n)], ["word", "n"])

    out = np.zeros(v)
    word, n = _columns(_met(two_columns(docs, id_col, text_col), keys_of, v + 2, v, counted=False).mapInArrow(lean(count), "word long, n long"))  # a row a word of the vocabulary
    known_words.destroy()
    out[word] = n
    return out


@dataclass
class Counts:
    """In how many learned-from texts of either class (rows: ordinary, toxic) is what."""

    word: np.ndarray  # of each word of the vocabulary
    of_left: np.ndarray  # pairs by their first word, if it or a pair of it may tell the classes apart
    types: np.ndarray  # distinct pairs by their first word, likewise
    key: np.ndarray  # first word * size of the vocabulary + second word: pairs that may tell the classes apart
    pair: np.ndarray  # of these


def _ways(n: np.ndarray) -> list[np.ndarray]:
    """Counts of either class without each part, and of all, from rows 2 * part + class."""
    of_part = n.reshape(PARTS, 2, -1)
    total = of_part.sum(axis=0)
    return [*(total - p for p in of_part), total]


def _words_apart(count: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each word's probability in either class, whether it tells them apart, its log ratio if so, and the distribution that both share."""
    shared = (contexts + 0.5) / (contexts + 0.5).sum()
    total = np.maximum(count.sum(axis=1), 1)
    p = (np.maximum(count - DISCOUNT, 0) + DISCOUNT * np.maximum((count > 0).sum(axis=1), 1)[:, None] * shared) / total[:, None]
    tells = _tells(count[1], count[0], total[1] / total.sum())
    return p, tells, np.where(tells, np.log(p[1] / p[0]), 0.0), shared


def _pairs_apart(n: np.ndarray, word_of_right: np.ndarray, odds: float) -> np.ndarray:
    """Whether pairs tell the classes apart beyond what their second words do."""
    odds = odds * np.exp(word_of_right)
    return (n.sum(axis=0) >= LEAST_TEXTS) & _tells(n[1], n[0], odds / (1 + odds))


def _odds(count: np.ndarray) -> float:
    total = np.maximum(count.sum(axis=1), 1)
    return total[1] / total[0]


def _estimated(c: Counts, vocabulary: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, ...]:
    """vocabulary, word, context, pairs, pair of a Model."""
    v = len(vocabulary)
    p, tells, word, shared = _words_apart(c.word, contexts)
    # What is no evidence is estimated for both classes at once: it backs off to one shared probability.
    lower = np.where(tells, p, (c.word.sum(axis=0) + shared) / (np.maximum(c.word.sum(axis=1), 1).sum() + 1))
    left, right = c.key // v, c.key % v
    told = _pairs_apart(c.pair, word[right], _odds(c.word))
    left, right, n = left[told], right[told], c.pair[:, told]
    weight = DISCOUNT * c.types.sum(axis=0) / np.maximum(c.of_left.sum(axis=0), 1)
    full = np.maximum(n - DISCOUNT, 0) / np.maximum(c.of_left[:, left], 1) + weight[left] * lower[:, right]
    # The classes' own back-off weights differ only after a word that tells them apart itself.
    own = np.where(c.of_left > 0, DISCOUNT * c.types / np.maximum(c.of_left, 1), 1.0)
    context = np.where(tells, np.log(np.maximum(own[1], 1e-9) / np.maximum(own[0], 1e-9)), 0.0)
    pair = np.log(full[1] / full[0]) - word[right] - context[left]
    hashed = mix(vocabulary[left] * _PAIR + vocabulary[right])
    order = np.argsort(hashed)
    return vocabulary, word, context, hashed[order], pair[order]


def _expressions(t: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words and pairs of a text, by the vocabulary. A text counts an expression once, however often it repeats it."""
    v = len(vocabulary)
    at = np.minimum(np.searchsorted(vocabulary, t), v - 1)
    known = vocabulary[at] == t
    both = known[1:] & known[:-1]
    return np.unique(at[known]), np.unique(at[:-1][both] * v + at[1:][both])


def _language_models(texts: list[np.ndarray], toxic: np.ndarray, vocabulary: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, ...]:
    """vocabulary, word, context, pairs, pair of a Model, from texts at hand."""
    v = len(vocabulary)
    if not v:
        return vocabulary, np.zeros(0), np.zeros(0), np.zeros(0, np.uint64), np.zeros(0)
    count, keys = np.zeros((2, v)), [np.zeros(0, np.int64)]
    for t, y in zip(texts, toxic):
        words, pairs = _expressions(t, vocabulary)
        count[y, words] += 1
        keys.append(pairs * 2 + y)
    key, n = _by_row(*np.unique(np.concatenate(keys), return_counts=True), 2)
    of_left, types = (np.stack([np.bincount(key // v, x, minlength=v) for x in m]) for m in (n, n > 0))
    return _estimated(Counts(count, of_left, types, key, n), vocabulary, contexts)


def _by_row(keys: np.ndarray, counts: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, and their counts by row, from sorted keys rows * pair + row."""
    key, at = np.unique(keys // rows, return_inverse=True)
    n = np.zeros((rows, len(key)))
    n[keys % rows, at] = counts
    return key, n


def logistic(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], size: int, ridge: float = 0.02) -> np.ndarray:
    """Weights (the last for 1) of a logistic regression, by Newton's method. ``sums`` gives the Hessian and the gradient of all rows at given weights."""
    b = np.zeros(size + 1)
    keep = np.full(size + 1, ridge)
    keep[-1] = 1e-6
    for _ in range(50):
        hessian, gradient = sums(b)
        step = np.linalg.solve(hessian + np.diag(keep), gradient - keep * b)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return b


def words_of(texts: list[str]) -> list[np.ndarray]:
    """The word hashes of each text, read in small slices: this runs on the driver."""
    out = []
    for at in range(0, len(texts), 64):
        for _, _, w, begin in column_words(pa.array(texts[at : at + 64], pa.string()), NO_LETTER, 1 << 17):
            out += [w[a:b] for a, b in zip(begin[:-1], begin[1:])]
    return out


def learned_from(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, y, code (2 * part + y) and text of all labelled rows outside the held-out fold; equal texts (A-Z lower-cased) of one class are one row, as a group of copies would make its every word evidence. Texts are shuffled once, and only labelled ones."""
    known = labelled_ids(labels, "toxic")
    ids = sieve(known.select(F.xxhash64("doc_id").alias("key")))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(ids.value.holds(batch.column("key"))))
            yield batch.select(["doc_id", "text"])

    rows = two_columns(docs, id_col, text_col).where(~held_out(F.col("doc_id"))).withColumn("key", F.xxhash64("doc_id"))
    rows = rows.mapInArrow(lean(some), "doc_id long, text string").join(known.hint("merge"), "doc_id")
    text = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    once = rows.groupBy(F.sha2(text, 256).alias("row"), "y").agg(F.min(text).alias("text"))
    out = written(once.withColumn("code", (F.pmod(F.xxhash64("row"), F.lit(PARTS)) * 2 + F.col("y")).cast("int")), "learned")
    ids.destroy()
    return out


def _word_counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The vocabulary of all texts, sorted, and in how many texts each word is: rows 2 * part + class."""
    names = [f"n{k}" for k in range(2 * PARTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            word, at = np.unique(np.concatenate([w for of_code in held for w in of_code]), return_inverse=True)
            ends = np.cumsum([sum(map(len, of_code)) for of_code in held])[:-1]
            n = [np.bincount(a, minlength=len(word)) for a in np.split(at, ends)]
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), *map(pa.array, n)], ["word", *names])

        held, size = [[] for _ in names], 0
        for batch in batches:
            code = batch.column("code").to_numpy()
            for first, _, words, begin in column_words(batch.column("text"), NO_LETTER):
                for t, (a, b) in enumerate(zip(begin[:-1], begin[1:]), first):
                    held[code[t]].append(np.unique(words[a:b]))
                    size += len(held[code[t]][-1])
                if size >= GATHERED:
                    yield counted()
                    held, size = [[] for _ in names], 0
        if size:
            yield counted()

    rows = texts.mapInArrow(lean(run), "word long, " + ", ".join(f"{n} long" for n in names)).groupBy("word").agg(*(F.sum(n).alias(n) for n in names))
    rows = rows.where(sum((F.col(n) for n in names), F.lit(0)) >= LEAST_TEXTS)
    word, *n = _columns(rows)
    word = word.view(np.uint64)
    order = np.argsort(word)
    return word[order], np.stack(n)[:, order].astype(float)


def _all_counts(texts: DataFrame, vocabulary: np.ndarray, word: np.ndarray, contexts: np.ndarray) -> Iterator[Counts]:
    """Counts of the texts without each part, and of all; of the pairs those that tell the classes apart in any of these."""
    v, context, codes = len(vocabulary), texts.sparkSession.sparkContext, 2 * PARTS
    known_words = context.broadcast(vocabulary)
    of_words = []
    for count in _ways(word):
        ratio = _words_apart(count, contexts)[2]
        some = np.flatnonzero(ratio)
        of_words.append((some, ratio[some], _odds(count)))
    apart = context.broadcast(of_words)

    def keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        code = batch.column("code").to_numpy()
        for first, _, words, begin in column_words(batch.column("text"), NO_LETTER):
            for t, (a, b) in enumerate(zip(begin[:-1], begin[1:]), first):
                yield _expressions(words[a:b], known_words.value)[1] * codes + code[t]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios, telling = [], np.zeros(v, bool)
        for some, ratio, _ in apart.value:
            ratios.append(np.zeros(v))
            ratios[-1][some] = ratio
            telling[some] = True
        for keys, counts in _merged(batches):
            key, n = _by_row(keys, counts, codes)
            ways = _ways(n)
            told = np.any([_pairs_apart(m, ratio[key % v], odds) for m, ratio, (_, _, odds) in zip(ways, ratios, apart.value)], axis=0)
            at = np.flatnonzero(np.diff(key // v, prepend=-1))
            sums = np.add.reduceat(np.concatenate([x for m in ways for x in (m, m > 0)]).astype(np.int64), at, axis=1)
            left = key[at] // v
            use = np.logical_or.reduceat(told, at) | telling[left]
            rows = [*sums[:, use].T.tolist(), *n[:, told].T.astype(np.int64).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((-1 - left[use], key[told]))), pa.array(rows, pa.list_(pa.int64()))], ["key", "n"])

    table = _met(texts, keys_of, codes * v, v).mapInArrow(lean(count), "key long, n array<long>").toArrow()
    known_words.destroy()
    apart.destroy()
    key = table["key"].to_numpy()
    # A first word's sums have negative keys.
    sums, pair = (pc.list_flatten(table["n"].filter(pa.array(own))).to_numpy().astype(float).reshape(-1, k).T for own, k in ((key < 0, 4 * (PARTS + 1)), (key >= 0, codes)))
    left, key = -1 - key[key < 0], key[key >= 0]
    for k, (of_word, of_pair) in enumerate(zip(_ways(word), _ways(pair))):
        dense = np.zeros((4, v))
        dense[:, left] = sums[4 * k : 4 * k + 4]
        yield Counts(of_word, dense[:2], dense[2:], key, of_pair)


def _curve(texts: DataFrame, without: list[Model]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic weights, centre and scale, from all texts, each scored by the model without its part."""
    models = texts.sparkSession.sparkContext.broadcast(without)
    names = ["y", *(f"x{k}" for k in range(4))]

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, part = batch.column("y").to_numpy(), batch.column("code").to_numpy() // 2
            x = np.zeros((len(batch), 4))
            for first, last, words, begin in column_words(batch.column("text"), NO_LETTER):
                ratio = np.stack([m.ratios(words, begin) for m in models.value])
                x[first:last] = _inputs(ratio[part[first:last], np.arange(last - first)], np.diff(begin))
            yield pa.RecordBatch.from_arrays([pa.array(y.astype(float)), *(pa.array(c) for c in x.T)], names)

    rows = written(texts.mapInArrow(lean(inputs), ", ".join(f"{n} double" for n in names)), "inputs")
    models.destroy()

    def summed(of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for batch in batches:
                y, *x = (c.to_numpy() for c in batch.columns)
                total = total + of(np.stack(x, 1), y)
            if np.ndim(total):
                yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["sums"])

        return np.sum([r["sums"] for r in rows.mapInArrow(run, "sums array<double>").collect()], axis=0)

    n, *moments = summed(lambda x, y: np.concatenate(([len(x)], x.sum(0), (x * x).sum(0))))
    centre = np.array(moments[:4]) / n
    scale = np.sqrt(np.maximum(np.array(moments[4:]) / n - centre**2, 0)) + 1e-9

    def newton(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            x = np.concatenate(((x - centre) / scale, np.ones((len(x), 1))), 1)
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            return np.concatenate((((x.T * (p * (1 - p))) @ x).ravel(), x.T @ (y - p)))

        sums = summed(of)
        return sums[:25].reshape(5, 5), sums[25:]

    return logistic(newton, 4), centre, scale


def _learned(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> Model | None:
    """The model, or none without texts of both classes."""
    for_workers(docs.sparkSession)
    with collecting() as made:
        texts = learned_from(docs, labels, id_col, text_col)
        model = _model(texts, docs, id_col, text_col) if texts.select("y").distinct().count() == 2 else None
    forget(docs.sparkSession, made)
    give_back()
    return model


def _model(texts: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> Model:
    vocabulary, word = _word_counts(texts)
    flat = (np.zeros(5), np.zeros(4), np.ones(4))
    if not len(vocabulary):
        none = Model(vocabulary, np.zeros(0), np.zeros(0), np.zeros(0, np.uint64), np.zeros(0), *flat)
        return replace(none, **dict(zip(("curve", "centre", "scale"), _curve(texts, [none] * PARTS))))
    contexts = continuations(docs, vocabulary, id_col, text_col)
    *without, model = (Model(*_estimated(c, vocabulary, contexts), *flat) for c in _all_counts(texts, vocabulary, word, contexts))
    return replace(model, **dict(zip(("curve", "centre", "scale"), _curve(texts, without))))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= 0.5) of each row; ``labels`` has doc_id and toxic."""
    model = docs.sparkSession.sparkContext.broadcast(_learned(docs, labels, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(len(batch))
            if model.value is not None:
                for first, last, words, begin in column_words(batch.column("text"), NO_LETTER):
                    score[first:last] = model.value.scores(words, begin)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    scored = two_columns(docs, id_col, text_col).mapInArrow(lean(run), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text is predicted toxic: all columns, in one pass; a null text counts as empty."""
    for_workers(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(_learned(docs, labels, id_col, text_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(len(batch))
            if model.value is not None:
                for first, last, words, begin in column_words(pc.fill_null(batch.column(at), ""), NO_LETTER):
                    score[first:last] = model.value.scores(words, begin)
            yield batch.filter(pa.array(score < 0.5))

    return docs.mapInArrow(lean(run), docs.schema)
