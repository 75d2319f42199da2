"""Periodic runs against brute force, and their defined cases."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa

from tidewater.llm import periodic_runs
from tidewater.llm.words import SEPARATOR
from tidewater.llm.word_spans import word_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least=12):
    """(start, length, period) of all runs, period by period."""
    out, n = [], len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            e = i + q
            if e - s >= max(least, 2 * q) and not any(w[s : e - d] == w[s + d : e] for d in range(1, q)):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def digests(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{k},{q}\n" for s, k, q in runs), " ".join(x for i, x in enumerate(w) if i not in dropped))]
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], *sha)


def made(r, letters, n):
    """Words with stretches that repeat, nested ones too."""
    w = [r.choice(letters) for _ in range(n)]
    for _ in range(r.randint(0, 3)):
        a, q = r.randint(0, n), r.randint(1, 9)
        w[a:a] = (w[a : a + q] or ["x"]) * r.randint(2, 8)
    return w


def as_columns(texts):
    for words in word_spans(pa.array(texts), SEPARATOR):
        yield words, periodic_runs.runs(words.coded()[0], words.begin)


def test_runs_equal_brute_force(monkeypatch):
    r = random.Random(5)
    texts = [" ".join(made(r, "ab" if k % 3 else "abcdefgh", r.randint(0, 60))) for k in range(300)]
    for pairs in (periodic_runs.PAIRS, 97):
        monkeypatch.setattr(periodic_runs, "PAIRS", pairs)
        for words, found in as_columns(texts):
            got = [(int(np.searchsorted(words.begin, s, side="right")) - 1, int(s), int(e - s), int(q)) for s, e, q in found.tolist()]
            want = [(t, words.begin[t] + s, k, q) for t, text in enumerate(texts) for s, k, q in brute(text.split())]
            assert got == want and len(want) > 300


def test_runs_where_every_hash_meets(monkeypatch):
    monkeypatch.setattr(periodic_runs.PrefixHash, "spans", lambda self, l, r: (r - l).astype(np.uint64))
    r = random.Random(6)
    texts = [" ".join(made(r, "abc", 30)) for _ in range(40)]
    for words, found in as_columns(texts):
        # Extensions that reach too far are cut back to the words' own; nothing that isn't periodic passes.
        assert all((words.coded()[0][s : e - q] == words.coded()[0][s + q : e]).all() for s, e, q in found.tolist())


def test_long_texts_end_soon():
    began = time.time()
    texts = ["w " * 200_000, " ".join(f"w{k % 5000}" for k in range(200_000)), " ".join(f"w{k}" for k in range(200_000))]
    (_, found), *_ = as_columns(texts)
    assert found.tolist() == [[0, 200_000, 1], [200_000, 400_000, 5000]]
    assert time.time() - began < 60


def test_words_are_joined(monkeypatch):
    monkeypatch.setattr("tidewater.llm.word_spans.AT_ONCE", 7)
    r = random.Random(2)
    texts = ["".join(r.choice(["a", "é", "漢", " ", "\n", "\x0b", "\x1c", "\xa0", "xyz"]) for _ in range(r.randint(0, 30))) for _ in range(200)] + ["", " "]
    for at_once in (50, 1 << 20):
        out = []
        for words in word_spans(pa.array(texts), SEPARATOR, at_once=at_once):
            keep = np.arange(len(words.start)) % 3 > 0
            got = words.joined(keep).to_pylist()
            codes, strings = words.coded()
            for t, (a, b) in enumerate(zip(words.begin, words.begin[1:])):
                own = WORD.findall(texts[words.first + t])
                assert [strings[int(c)].as_py().decode() for c in codes[a:b]] == own
                assert got[t] == " ".join(x for x, k in zip(own, keep[a:b]) if k)
            out += got
        assert len(out) == len(texts)


def test_run_digests(spark):
    r = random.Random(9)
    rows = [(k, " ".join(made(r, "ab" if k % 2 else "abcdef", r.randint(0, 80))), 0) for k in range(-100, 400)]
    rows += [(1000, None, 1), (1001, "", 2), (1002, " \n\t ", 3), (1003, "a", 4), (1003, "a", 4), (None, "a b " * 12, 5), (1004, "The the THE " * 9, 6), (1005, "né né\x0bné\xa0 " * 30, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = sorted((tuple(x) for x in periodic_runs.run_digests(docs).collect()), key=str)
    assert got == sorted((digests(i, t) for i, t, _ in rows), key=str)
    assert sum(g[1] > 0 for g in got) > 100
    assert periodic_runs.run_digests(docs.limit(0)).count() == 0


def test_planting_leaves_texts_without_words(spark):
    chosen = [k for k in range(300) if zlib.crc32(str(k).encode()) % 10 == 0][:5]
    rows = list(zip(chosen, (None, "", " \n\t ", "a", "a b c d " * 9)))
    got = periodic_runs.run_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert sorted(tuple(x) for x in got) == sorted(digests(*x) for x in rows)


def test_query_on_its_table(spark):
    from tidewater.llm.queries import queries

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(x) for x in queries()["op11_periodic_runs"](spark, sf).collect())
    some = [d for d in docs if len(d["text"] or "") < 4000]
    want = sorted(digests(d["doc_id"], d["text"]) for d in some)
    assert [g for g in got if g[0] in {d["doc_id"] for d in some}] == want and len(got) == len(docs)
