"""Language-model scores against a trie of dictionaries, and their defined cases."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from tidewater.llm import lm_scoring, ppm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def scored_only(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


class Trie:
    def __init__(self, texts):
        self.nodes = [collections.defaultdict(collections.Counter) for _ in range(ppm.ORDER + 1)]
        for data in texts:
            for k, symbol in enumerate(data):
                self.nodes[-1][self.context(data, k, ppm.ORDER)][symbol] += 1
        for order in range(ppm.ORDER, 0, -1):
            for context, symbols in self.nodes[order].items():
                self.nodes[order - 1][context[1:]].update(symbols.keys())

    @staticmethod
    def context(data, k, order):
        return (b"\n" * order + data[:k])[len(data[:k]):] if order else b""

    def log(self, data):
        out = 0.0
        for k, symbol in enumerate(data):
            taken, context = set(), self.context(data, k, ppm.ORDER)
            for order in range(ppm.ORDER, -1, -1):
                left = {s: n for s, n in self.nodes[order].get(context[ppm.ORDER - order:], {}).items() if s not in taken}
                total = sum(left.values())
                if symbol in left:
                    out += math.log10((left[symbol] - ppm.DISCOUNT) / total)
                    break
                if total:
                    out += math.log10(ppm.DISCOUNT * len(left) / total)
                taken |= left.keys()
            else:
                out -= math.log10(ppm.ALPHABET - len(taken))
        return out


def brute(rows):
    tokens = [WORD.findall((t or "").translate(LOWER)) + [None] for _, t in rows]
    learned = [t for (i, _), t in zip(rows, tokens) if not scored_only(i)]
    count = collections.Counter(x for t in learned for x in t)
    n, v = sum(count.values()), len(count)
    stream = lambda t: b" ".join(w.encode() for w in t[:-1]) + b"\n"
    trie = Trie(map(stream, learned))
    out = []
    for (i, _), t in zip(rows, tokens):
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)
        out.append((i, scored_only(i), len(t), sum(count[x] > 0 for x in t), n, base, trie.log(stream(t))))
    return out


def texts(seed, n):
    r = random.Random(seed)
    words = ["The", "the", "cat", "né", "NÉ", "漢字", "sat,", "\xa0", "\x00x", "don't", *("".join(r.choice("abcde") for _ in range(r.randint(1, 6))) for _ in range(60))]
    return [(k, r.choice([" ", "\n", " \t "]).join(r.choice(words) for _ in range(r.randint(0, 40)))) for k in range(n)]


CASES = [(1000, None), (1001, ""), (1002, " \n\t "), (None, "no id at all"), (1003, "x" * 5000), (1004, "again and again"), (1004, "again and again"), (1006, "ÿþ rare letters ☃")]


def compared(spark, rows):
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    got = [tuple(r) for r in lm_scoring.lm_scores(docs).collect()]
    key = lambda r: (str(r[0]), r[6])
    got, want = sorted(got, key=key), sorted(brute(rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    np.testing.assert_allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-9)
    return got


@pytest.mark.parametrize("grams, words", [(1 << 21, 1 << 20), (0, 0), (300, 10)])
def test_scores_equal_a_trie_of_dictionaries(spark, monkeypatch, grams, words):
    monkeypatch.setattr(lm_scoring, "GRAMS", grams)
    monkeypatch.setattr(lm_scoring, "WORDS", words)
    if grams == 0:  # small buckets, many sendings, and buckets that are split
        monkeypatch.setattr(lm_scoring, "GATHERED", 100)
        monkeypatch.setattr(lm_scoring, "ANSWERED", 30)
        monkeypatch.setattr(lm_scoring, "BUCKETS", 8)
    got = compared(spark, texts(3, 120) + CASES)
    assert any(g[1] for g in got)


def test_nothing_to_learn_and_nothing_to_score(spark):
    only = [k for k in range(60) if scored_only(k)][:3]
    got = compared(spark, [(k, "some words") for k in only])
    assert all(g[4] == 0 and g[5] == 0 for g in got)
    assert lm_scoring.lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_each_context_has_shares_that_sum_to_one():
    r = np.random.default_rng(4)
    data = r.integers(97, 102, 3000).astype(np.uint8)
    data[-1] = 10
    keys, n = np.unique(ppm.grams(data, np.array([0, len(data)])), return_counts=True)
    low = ppm.levels(*_low_entries(keys), ppm.LOW, 0, None)
    trie = {**low, **ppm.levels(keys, n, ppm.ORDER, ppm.LOW + 1, low[ppm.LOW])}
    letters = np.array([b for b in range(256) if b not in (9, 11, 12, 13)], np.uint64)
    for context in (b"abcabc", b"zzzzzz", b"aaazzz", b"ab\n\n\n\n"):
        key = np.uint64(int.from_bytes(context, "big"))
        p = np.exp(ppm.log_probabilities(key << np.uint64(8) | letters, trie))
        assert abs(p.sum() - 1) < 1e-9 and len(p) == ppm.ALPHABET


def _low_entries(keys):
    n = None
    for k in range(ppm.ORDER, ppm.LOW, -1):
        keys, n = ppm.shortened(keys, k)
    return keys, n


def test_the_model_beats_the_word_base(spark):
    from tidewater.llm.queries import queries

    rows = [r for r in queries()["op13_lm_scoring"](spark, "/root/testdata/sf0.1").collect() if r["held_out"]]
    assert len(rows) > 1000
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
