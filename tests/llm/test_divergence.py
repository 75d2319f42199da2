"""The source divergence audit against its SQL, brute force and built cases."""

import collections
import random
import re

import duckdb
import numpy as np
import pyarrow as pa

from tidewater.llm import source_divergence
from tidewater.llm.queries import OP12_SQL

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, lang string, source string, text string, term string, p long"


def brute(rows):
    rows = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        docs, total, of = collections.Counter(), collections.Counter(), collections.defaultdict(collections.Counter)
        for one, source, terms in rows:
            if one == lang:
                docs.update(set(terms))
                total.update(terms)
                of[source].update(terms)
        kept = [t for t in total if docs[t] >= 3]

        def shares(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        q, p = shares(total), {s: shares(c) for s, c in of.items()}
        for s in of:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in of if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t) for t in kept if of[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, 200)):
                out += [(lang, s, part, item, -value, k + 1) for k, (value, item) in enumerate(sorted(items, key=lambda x: (x[0], x[1].encode()))[:most])]
    return sorted(out)


def collected(spark, rows):
    docs = spark.createDataFrame([(k, *r, "clash", k) for k, r in enumerate(rows)], SCHEMA)
    return sorted(tuple(r) for r in source_divergence.divergence(docs).collect())


def test_against_brute_force_and_sql(spark):
    r = random.Random(4)
    words = ["The", "the", "né", "NÉ", "É", "漢字", "x1y", "don't", "\xa0a", "rare", *(f"w{'abcdefghij'[k]}" for k in range(10))]
    rows = [(r.choice(["en", "EN", None, ""]), r.choice(["a", "B", "é", None, "hot", "hot", "hot"]), " ".join(r.choice(words) for _ in range(r.randint(0, 12)))) for _ in range(150)]
    rows += [("de", "a", "zwei mal"), ("de", "b", "zwei mal"), ("de", "b", "zwei mal"), ("fr", "none", None), ("fr", "other", ""), ("it", "alone", "... 12"), ("en", "a", "x" * 50000 + " y" * 50000)]
    rows += [("en", "a", "The the THE")] * 5
    got = collected(spark, rows)
    assert got == brute(rows)
    assert {(g[0], g[4]) for g in got if g[0] == "fr"} == {("fr", 0)}
    con = duckdb.connect()
    con.register("documents", pa.table([pa.array(c) for c in zip(*rows)], ["lang", "source", "text"]))
    assert sorted(con.sql(OP12_SQL).fetchall()) == got


def test_empty_table(spark):
    assert collected(spark, []) == []


def test_sketch_never_underestimates(spark, monkeypatch):
    monkeypatch.setattr(source_divergence, "CHUNK", 64)
    r = random.Random(8)
    rows = [("en", "s", " ".join("".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(20))) for _ in range(60)]
    docs = collections.Counter(t for _, _, text in rows for t in set(text.split()))
    width = 256
    table = source_divergence.sketch(source_divergence._rows(spark.createDataFrame(rows, "lang string, source string, text string").repartition(7), "lang", "source", "text"), width)
    terms = [t.encode() for t in docs]
    name = source_divergence._hashed_names(pa.array(["en"]))[1]
    estimate = np.min([row[c] for row, c in zip(table, source_divergence._cells(name[np.zeros(len(terms), int)], source_divergence.word_hashes(terms), width))], axis=0)
    assert (estimate >= np.minimum([docs[t.decode()] for t in terms], source_divergence.LEAST_DOCS)).all()


def test_a_narrow_sketch_gives_the_same(spark, monkeypatch):
    r = random.Random(12)
    rows = [(r.choice(["en", "de"]), r.choice("abc"), " ".join("".join(r.choice("abcd") for _ in range(r.randint(1, 4))) for _ in range(15))) for _ in range(80)]
    monkeypatch.setattr(source_divergence, "WIDTHS", (16, 16))
    monkeypatch.setattr(source_divergence, "GATHERED", 50)
    assert collected(spark, rows) == brute(rows)


def test_shares_by_long_division(spark):
    big = [(0, 1), (5, 7), (10**15, 3 * 10**15), (8 * 10**15, 8 * 10**15 + 1), (0, 9 * 10**15)]
    got = spark.createDataFrame(big, "n long, total long").select("n", "total", source_divergence._share("n", "total").alias("p")).collect()
    assert [r["p"] for r in got] == [1 + 10**9 * (n + 1) // t for n, t in big]
