"""The corpus operators against the libraries, brute force and planted cases; and their defined cases."""

import hashlib
import itertools
import os
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidewater.llm import bpe_codec, exact_dedup, fingerprints, id_files, jaccard_join, packing, pii, prefix_hash, quality, repair, token_counts, toxicity, trees, words
from tidewater.llm.bytebpe import tokenizer_path

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BITS = [" ", "  ", "\n", "\t", "a", "aa", "aaa", "B", "é", "É", "ß", "9", "99", "١", "²", ".", "!!", "--", "'s", "'ll", "<|endoftext|>", "<|startoftext|>", "<|", "\x1c", "\xa0", "　", "漢字", "😀", "́", "Hello", "world", "\r\n", "\x00", "\x85", "İ", "Σ", "\xad"]
#: Null, empty, white space, ties, repeated rows, a very long text, and a column whose name clashes.
CASES = [(1, None, 1), (2, "", 2), (3, " \n\t ", 3), (4, "The cat sat.", 4), (5, "the cat sat.", 5), (5, "the cat sat.", 5), (6, "word " * 30000, 6), (7, "x" * 60000, 7), (None, "no id", 8), (8, "tel 555-123-4567 a@b.org", 9)]
SCHEMA = "doc_id long, text string, n int"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


@pytest.fixture(scope="module")
def odd_texts():
    r = random.Random(3)
    return ["".join(r.choice(BITS) for _ in range(r.randint(0, 25))) for _ in range(1500)] + ["a" * k for k in range(30)] + [" " * k + "x" for k in range(9)]


def frame(spark, rows=CASES):
    return spark.createDataFrame(rows, SCHEMA)


def ids_of(library, path, text):
    return library[path].encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_counts_and_codec_equal_the_library(library, odd_texts):
    count, codec = token_counts.Counter(BYTE), bpe_codec.Codec(BYTE)
    for t in odd_texts:
        want = ids_of(library, BYTE, t)
        assert count(t) == len(want)
        assert codec.encode(t) == packed(want)
        assert codec.decode(packed(want)) == library[BYTE].decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("path, spaced", [(BYTE, True), (WORD, False)])
def test_remembered_pieces_equal_whole_texts(library, odd_texts, path, spaced):
    from tidewater.llm.library_ids import LibraryIds

    made = LibraryIds(path, spaced)
    made.words.size = made.pieces.size = 50  # generations turn over
    r = random.Random(7)
    plain = [b for b in BITS if all(c in "\n\t" or 32 <= ord(c) < 127 or 161 <= ord(c) < 256 for c in b)] + ["'", "'re", "'S", "'d", "ve", "×", "ª", "µ", "¼", "¡"]
    texts = odd_texts + ["".join(r.choice(plain) for _ in range(r.randint(0, 20))) for _ in range(4000)]
    for t in texts[::10]:
        assert made(t) == packed(ids_of(library, path, t))
    ids, ends = made.run(pa.array(texts, pa.large_string()))
    for t, a, b in zip(texts, [0, *ends[:-1]], ends):
        assert ids[a:b].tolist() == ids_of(library, path, t)


def test_long_texts_in_slices(library, monkeypatch):
    from tidewater.llm import library_ids

    monkeypatch.setattr(library_ids, "RUN", 300)
    texts = ["It's a  test, don't\n " * 90, "x" * 2000, "", "ab " * 400, "é" * 900 + " 漢字" * 100]
    made = library_ids.LibraryIds(BYTE, True)
    for first, last, ids, ends in made.batches(pa.array(texts)):
        for t, a, b in zip(texts[first:last], [0, *ends[:-1]], ends):
            assert ids[a:b].tolist() == ids_of(library, BYTE, t)


def test_whole_tokens_are_proven(library):
    alone = token_counts.Counter(BYTE).vocabulary.alone
    r = random.Random(1)
    for s in r.sample(sorted(alone), 300):
        assert len(ids_of(library, BYTE, s)) == 1


def test_one_word_of_a_million_letters(spark, library):
    r = random.Random(2)
    words = ["".join(r.choice("ACGT") for _ in range(1_000_000)), "é" * 100_000 + "x" * 900_000]
    rows = [(k, w, 0) for k, w in enumerate(words)]
    want = [ids_of(library, BYTE, w) for w in words]
    began = time.time()
    assert [r["n_tokens"] for r in token_counts.token_counts(frame(spark, rows)).orderBy("doc_id").collect()] == list(map(len, want))
    got = [(r["n_tokens"], r["ids_sha256"]) for r in bpe_codec.round_trip(frame(spark, rows)).orderBy("doc_id").collect()]
    assert got == [(len(x), hashlib.sha256(packed(x)).hexdigest()) for x in want]
    assert time.time() - began < 60


def test_a_vocabulary_without_all_letters_is_refused():
    codec = bpe_codec.Codec(BYTE)
    codec.automaton = bpe_codec.ahocorasick.Automaton()
    codec.automaton.add_word("a", (1, codec.vocabulary.byte_id[97]))
    codec.automaton.make_automaton()
    with pytest.raises(ValueError, match="no tokens"):
        codec.prefixes(b"ab")


def test_token_counts(spark, library):
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(frame(spark)).collect())
    want = sorted((str(i), len((t or "").encode()), n := len(ids_of(library, BYTE, t)), n > 1024) for i, t, _ in CASES)
    assert got == want
    assert token_counts.token_counts(frame(spark, [])).count() == 0


def test_round_trip(spark, library):
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe_codec.round_trip(frame(spark)).collect())
    want = sorted((str(i), len(x := ids_of(library, BYTE, t)), hashlib.sha256(packed(x)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in CASES)
    assert got == want
    back = bpe_codec.decode(bpe_codec.encode(frame(spark)))
    assert sorted((str(r["doc_id"]), r["text"]) for r in back.collect()) == sorted((str(i), t or "") for i, t, _ in CASES)


def test_grammar_round_trip_and_random_access():
    r = np.random.default_rng(1)
    for n, k in ((0, 1), (1, 3), (2, 1), (3000, 4), (20000, 40)):
        ids = r.integers(0, k, n).astype("u4") * 7
        ends = np.append(np.sort(r.integers(0, n + 1, 12)), n)
        g = repair.compress(ids, ends)
        made = repair.Grammar(g["alphabet"], g["rules"], g["expansion"])
        assert (made.expand(g["sequence"]) == ids).all()
        for a, b, c, d in zip(np.append(0, g["ends"][:-1]), g["ends"], np.append(0, ends[:-1]), ends):
            assert (made.expand(g["sequence"][a:b]) == ids[c:d]).all()
    assert len(g["rules"]) and len(g["sequence"]) < n


def test_grammar_goes_on_until_no_pair_is_frequent():
    r = np.random.default_rng(5)
    run, copied, mixed = np.full(5000, 3, "u4"), np.tile(r.integers(0, 500, 300).astype("u4"), 40), r.integers(0, 4, 6000).astype("u4")
    for docs in ([run], [run[:1], run[:2], run[:999], run], [copied], [run, copied, mixed, run[:77]]):
        ids, ends = np.concatenate(docs), np.cumsum([len(d) for d in docs])
        g = repair.compress(ids, ends)
        made = repair.Grammar(g["alphabet"], g["rules"], g["expansion"])
        for a, b, d in zip(np.append(0, g["ends"][:-1]), g["ends"], docs):
            assert (made.expand(g["sequence"][a:b]) == d).all()
        left: dict[tuple[int, int], int] = {}
        for a, b in zip(np.append(0, g["ends"][:-1]).tolist(), g["ends"].tolist()):
            last: dict[tuple[int, int], int] = {}
            for k in range(a, b - 1):
                pair = (int(g["sequence"][k]), int(g["sequence"][k + 1]))
                if last.get(pair) != k - 1 or pair[0] != pair[1]:  # places that don't overlap
                    left[pair] = left.get(pair, 0) + 1
                    last[pair] = k
        assert max(left.values(), default=0) < repair.LEAST


def test_id_files(spark, library, tmp_path):
    rows = [c for c in CASES if c[0] is not None]
    to = f"file://{tmp_path}/ids"
    id_files.write_ids(frame(spark, rows), to)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in id_files.read_ids(spark, to).collect())
    want, start = [], 0
    for i, t, _ in sorted(rows, key=lambda c: (c[0], c[1] or "")):
        x = ids_of(library, BYTE, t) + [0]
        want.append((start, i, len(x), zlib.crc32(packed(x)), packed(x)))
        start += len(x)
    assert got == want
    assert id_files.read_document(spark, to, 4) == [ids_of(library, BYTE, "The cat sat.") + [0]]
    assert id_files.id_digests(frame(spark, [])).count() == 0


def test_rows_without_an_id_are_written_first(spark):
    got = {r["doc_id"]: r["start"] for r in id_files.id_digests(frame(spark)).collect()}
    assert got[None] == 0 and len(got) == len({c[0] for c in CASES})


def test_plan_keeps_every_piece():
    r = np.random.default_rng(2)
    for _ in range(200):
        counts = {int(k): int(v) for k, v in zip(*np.unique(r.integers(1, 11, r.integers(1, 60)), return_counts=True))}
        first, then = packing.best_fit(counts, 10), packing.plan(counts, 10)
        for bins in (first, then):
            left = {}
            for pattern, n in bins.items():
                assert sum(pattern) <= 10 and n > 0
                for x in pattern:
                    left[x] = left.get(x, 0) + n
            assert left == counts
        assert -(-sum(k * v for k, v in counts.items()) // 10) <= sum(then.values()) <= sum(first.values())


def test_local_search_empties_bins():
    counts = dict.fromkeys(range(300, 720), 12)
    assert sum(packing.plan(counts, 2048).values()) < sum(packing.best_fit(counts, 2048).values())


def test_local_search_leaves_no_exchange():
    counts = dict.fromkeys(range(300, 720, 3), 3)
    bins = packing.plan(counts, 2048)
    assert sum(bins.values()) < sum(packing.best_fit(counts, 2048).values())
    under = sorted((sum(p), p) for p in bins if sum(p) < 2048)
    some = lambda p, k: {sum(x): x for x in itertools.combinations(p, k)}
    if sum(bins.values()) > -(-sum(k * v for k, v in counts.items()) // 2048):
        for i, (_, low) in enumerate(under):
            for fill, high in under[i:]:
                if low != high or bins[low] > 1:
                    for get, give in ((1, 0), (1, 1), (2, 0), (2, 1), (1, 2)):
                        assert not any(0 < x - y <= 2048 - fill for x in some(low, get) for y in some(high, give))


def test_packing(spark, library):
    got = packing.pack(frame(spark)).toPandas()
    for (i, t), n in {(c[0], c[1]): sum(d[:2] == c[:2] for d in CASES) for c in CASES}.items():
        x = ids_of(library, WORD, t) + [0]
        own = got[got.doc_id.isna() if i is None else got.doc_id == i]
        assert len(own) == n * -(-len(x) // 2048)
        for r in own.itertuples():
            y = x[r.start : r.start + r.length]
            assert r.start == 2048 * r.piece and len(y) == r.length and zlib.crc32(packed(y)) == r.ids_crc32
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == (g.length.cumsum() - g.length).tolist() and g.length.sum() <= 2048
    assert packing.pack(frame(spark, [])).count() == 0


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups(spark, keep):
    r = random.Random(4)
    rows = [(i, r.choice(["a", "A", "b", "É", "é", None, "", "x" * 500, "x" * 500 + "Y"]), 0) for i in range(300)] + CASES
    want, groups = [], {}
    for i, t, _ in rows:
        groups.setdefault((t or "").translate(ASCII_LOWER), []).append(i)
    for t, ids in groups.items():
        there = [i for i in ids if i is not None]
        k = (max if keep == "largest" else min)(there) if there else None
        done = False
        for i in ids:
            kept = i == k and not done
            done |= kept
            want.append((i, k, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    got = exact_dedup.exact_groups(frame(spark, rows), keep).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0


def test_one_group_over_all_partitions(spark):
    rows = [(i, "same" if i % 3 else "Same", 0) for i in range(400)]
    got = exact_dedup.exact_groups(frame(spark, rows), "largest").collect()
    assert {(r["keep_id"], r["group_size"]) for r in got} == {(399, 400)} and [r["doc_id"] for r in got if r["kept"]] == [399]
    assert [tuple(r) for r in exact_dedup.dedup(frame(spark, rows)).collect()] == [rows[0]]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup_of_repeated_rows(spark, keep):
    r = random.Random(9)
    rows = [(r.choice([*range(60), None]), r.choice(["a", "A", "b", "é", None, "x" * 500, *(f"own {k}" for k in range(90))]), r.randrange(3)) for _ in range(500)]
    rows += [(70, "repeated", 1), (70, "repeated", 2), (71, "REPEATED", 3), (72, "one", 4), (72, "only here", 5), (0, "one", 6), (None, "no id", 7), (None, "no id", 8)] + [(99, "many", 0)] * 50
    rows += [(73, "as it is", 9)]
    got = [tuple(x) for x in exact_dedup.dedup(frame(spark, rows), keep).collect()]
    groups = {}
    for i, t, n in rows:
        groups.setdefault((t or "").translate(ASCII_LOWER), []).append((i, t, n))
    assert len(got) == len(groups) and set(got) <= set(rows)
    for i, t, _ in got:
        there = [x for x, _, _ in groups.pop((t or "").translate(ASCII_LOWER)) if x is not None]
        assert i == ((max if keep == "largest" else min)(there) if there else None)
    assert not groups
    assert exact_dedup.dedup(frame(spark, [])).count() == 0


def test_near_dedup_of_repeated_rows(spark):
    r = random.Random(10)
    text = lambda n=40: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    near = lambda t: t + " changed"
    a, b, c, d, e = (text() for _ in range(5))
    # Repeated rows; one identifier on a near copy and a text of its own; and on near copies of each other; two components of one smallest identifier.
    rows = [(1, a, 1), (1, a, 1), (1, a, 2), (2, near(a), 3), (2, b, 4), (3, c, 5), (3, near(c), 6), (4, d, 7), (4, e, 8), (5, near(d), 9), (5, near(e), 10)]
    rows += [(6, "", 11), (6, None, 12), (6, "", 11), (None, a, 13), (None, a, 13)]
    got = [tuple(x) for x in jaccard_join.dedup(frame(spark, rows)).collect()]
    one = [x for x in got if x[0] == 3]
    assert len(one) == 1 and one[0] in rows
    want = [(1, a, 1), (2, b, 4), (4, d, 7), (4, e, 8)] + rows[-5:]
    assert sorted(map(str, got)) == sorted(map(str, want + one))
    assert jaccard_join.dedup(frame(spark, [])).count() == 0


def test_rows_of_one_group_over_partitions(spark):
    """A group that fills many partitions, between others, and rows that differ by other columns alone."""
    rows = [(i % 900, "Many of these", i) for i in range(3000)] + [(i, f"own {i}", 0) for i in range(50)] + [(None, "Many of these", -1)]
    df = frame(spark, rows).repartition(9)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        for keep, best in (("smallest", (0, "Many of these", 0)), ("largest", (899, "Many of these", 899))):
            got = [tuple(x) for x in exact_dedup.dedup(df, keep).collect()]
            assert sorted(got) == sorted([best] + rows[3000:3050])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_dedup_passes_on_all_columns(spark):
    docs = frame(spark, [(1, "a b", 1), (1, "a b", 2), (2, "c d", 3)]).selectExpr("doc_id", "text", "map('k', n) as row", "n as _id")
    for dedup in (exact_dedup.dedup, jaccard_join.dedup):
        assert sorted((x["doc_id"], x["row"]["k"], x["_id"]) for x in dedup(docs).collect()) == [(1, 1, 1), (2, 3, 3)]


def test_prefix_hashes():
    r = random.Random(2)
    t = "".join(r.choice("ab é😀") for _ in range(900))
    t = t[:300] * 2 + t
    h = prefix_hash.PrefixHash(prefix_hash.code_points([t])[0])
    for _ in range(500):
        a, b, n = r.randrange(1000), r.randrange(1000), r.randrange(200)
        if r.random() < 0.3:
            b = (a + 300) % 900
        assert h.equal(a, b, n) == (t[a : a + n] == t[b : b + n])
        most = len(t) - max(a, b)
        k = int(h.common(np.array([a]), np.array([b]), np.array([most]))[0])
        assert t[a : a + k] == t[b : b + k] and (k == most or t[a + k] != t[b + k])


def test_edited_likeness(spark):
    r = random.Random(6)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    rows = [(i, text(120), 0) for i in range(40)] + [(40, None, 0), (41, "", 0), (42, "é😀", 0)]
    rows += [(43, rows[0][1], 0), (44, rows[0][1], 0)]
    got = {r["doc_id"]: r for r in fingerprints.edited_likeness(frame(spark, rows)).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, t, _) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        if i < 40 and i:
            assert got[i]["near_next"] < 0.1 < got[i]["near_edited"] < 0.7
            assert got[i]["common_prefix"] >= len(t) - len(t) // 2
    assert got[44]["near_next"] == 1.0 and got[44]["fingerprint"] == got[43]["fingerprint"] == got[0]["fingerprint"] != got[1]["fingerprint"]
    assert got[41]["near_next"] == 1.0
    assert fingerprints.edited_likeness(frame(spark, [])).count() == 0


def test_likeness_over_all_lengths():
    """Bins hold the least of all spans whatever the length, so that texts of any two lengths compare."""
    r = random.Random(8)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    spans = lambda t: {t[k : k + fingerprints.SPAN] for k in range(len(t) - fingerprints.SPAN + 1)}
    t, long = text(2040), text(3000)
    pairs = [(t, t + text(24)), (long, long[:1500] + text(300)), (long, long[:2040]), (text(30000) + t, t), (t, text(2100)), (long * 9, long), ("ab" * 4000, "ab" * 40)]
    for a, b in pairs:
        bins, *_ = fingerprints.sketches([a, b])
        want = len(spans(a) & spans(b)) / len(spans(a) | spans(b))
        assert abs(fingerprints.likeness(bins[:1], bins[1:])[0] - want) < 0.17
        for one, alone in zip(bins, (a, b)):  # by brute force: every span in its bin
            h = prefix_hash.PrefixHash(prefix_hash.code_points([alone])[0])
            at = np.arange(len(alone) - fingerprints.SPAN + 1)
            values = fingerprints._mixed(h.spans(at, at + fingerprints.SPAN) * fingerprints._MIX)
            for k in range(fingerprints.BINS):
                mine = values[(values & np.uint64(63)) == k]
                assert one[k] == (int(fingerprints._mixed(mine.min(keepdims=True) >> np.uint64(6))[0]) % fingerprints.EMPTY if len(mine) else fingerprints.EMPTY)


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components_of(rows, k, percent):
    rows = [(i, shingles(t, k)) for i, t, _ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(rows[a][1] & rows[b][1])
            if both and 100 * both >= percent * len(rows[a][1] | rows[b][1]) and None not in (rows[a][0], rows[b][0]):
                parent[root(a)] = root(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[root(x)] = min(least.get(root(x), i), i)
    return sorted(str((i, len(s), i if i is None or not s else least[root(x)])) for x, (i, s) in enumerate(rows))


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_jaccard_components(spark, k, percent):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randint(1, 5)))
    rows, n = list(CASES), 10
    for size in (3, 6, 9, 14, 22, 40, 90, 200):
        for _ in range(3):
            base = [word() for _ in range(size)]
            for _ in range(14):  # edited so that about half of the pairs link
                w = list(base)
                for _ in range(r.randint(0, max(1, size // 40))):
                    w[r.randrange(len(w))] = word()
                rows.append((n, " ".join(w) + r.choice(["", " ", "\n"]), 0))
                n += 1
    got = jaccard_join.link_components(frame(spark, rows), k, percent).collect()
    assert sorted(str(tuple(x)) for x in got) == components_of(rows, k, percent)


def test_jaccard_of_nothing(spark):
    assert jaccard_join.link_components(frame(spark, [])).count() == 0
    kept = jaccard_join.dedup(frame(spark, [(1, "a b c d e f", 0), (2, "a b c d e f", 0), (3, None, 0), (4, "", 0)]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]


def test_shingles_in_any_order_differ():
    column = pa.array(["x y y x y x x y", "a " * 9, "", "one"])
    for first, sets, begin in words.shingle_sets(column, 4):
        assert np.diff(begin).tolist() == [5, 1, 0, 1]


def test_word_hashes_are_of_the_words():
    r = random.Random(3)
    some = ["".join(r.choice("abAB\x00é") for _ in range(r.choice([1, 2, 7, 8, 9, 15, 16, 17, 31, 32, 33, 40, 90]))) for _ in range(3000)]
    some += [w + x for w in some[:200] for x in ("\x00", "a", "A")]
    (_, _, (one, two), begin), = words._column_words(pa.array([" ".join(some)]), words.SEPARATOR, 1 << 20, 2)
    assert begin.tolist() == [0, len(some)]
    by_word = {}
    for w, h in zip(some, zip(one.tolist(), two.tolist())):
        assert by_word.setdefault(w.translate(ASCII_LOWER), h) == h
    assert len({h for h, _ in by_word.values()}) == len({h for _, h in by_word.values()}) == len(by_word)


def test_long_words_of_one_structure_differ(spark):
    """A Thue-Morse word and its complement, which meet under any polynomial hash modulo 2^64."""
    bits = [bin(k).count("1") & 1 for k in range(1024)]
    rows = [(1, "".join("ab"[b] for b in bits), 0), (2, "".join("ba"[b] for b in bits), 0)]
    assert sorted(x["component_id"] for x in jaccard_join.link_components(frame(spark, rows)).collect()) == [1, 2]


def test_sets_of_one_name_are_told_apart(spark):
    df = spark.createDataFrame([(1, 7, 1), (2, 7, 2), (3, 8, 3)], "doc_id long, node long, check long")
    clashing = spark.createDataFrame([(7, True)], "node long, clash boolean")
    got = {r["doc_id"]: r["node"] for r in jaccard_join._renamed(df, clashing).collect()}
    assert len(set(got.values())) == 3 and got[3] == 8
    assert jaccard_join._renamed(df, None) is df


def test_common_shingles_need_both_hashes():
    u = lambda *x: np.array(x, np.uint64)
    assert jaccard_join.common((u(1, 5, 9), u(1, 1, 1)), (u(1, 9), u(1, 2))) == 1
    assert jaccard_join.common((u(), u()), (u(1), u(1))) == 0


def rule_spans(text):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in re.sub("[ -]", "", m[0])]
        if 16 <= len(d) <= 19 and sum(sum(divmod(2 * v, 10)) if k % 2 else v for k, v in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]


def test_pii_base_spans(spark):
    r = random.Random(5)
    bits = ["a", "b.", "@", ".", "..", "com", "-", "%", "+", "1", "22", "333", "4444", "5555 ", "0", "00256", "255", " ", "  ", "(", ")", "é", "😀", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "4111111111111111", "4111 1111-1111 1111", "+1 (555) 555-1234", "\n"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 30))), 0) for i in range(800)]
    rows += [(900 + k, t, 0) for k, t in enumerate(["1" * 30000, "a" * 30000, "1 " * 20000, "+" * 500, "+" + "1" * 20000, "a." * 9000 + "@", "(at)" * 900, None])]
    got = {x["doc_id"]: x for x in pii.find_pii(frame(spark, rows)).collect()}
    for i, t, _ in rows:
        spans = rule_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s.startswith(k + ":") for s in spans) for k in ("email", "ip", "card", "phone")]
        assert set(spans) <= set(got[i]["spans"].split(","))


def test_pii_candidates(spark):
    rows = [(1, "call tel 555-123-4567 now", 0), (2, "mail me: foo (at) bar (dot) com please", 0), (3, "my ssn is 219-09-1234.", 0), (4, "version 2024-10-11 has 1,234 items and page 555", 0), (5, "plain words only", 0)]
    got = {x["doc_id"]: x["spans"] for x in pii.find_pii(frame(spark, rows)).collect()}
    assert "national_phone" in got[1] and "disguised_email" in got[2] and "personal_number" in got[3] and got[4] == got[5] == ""


def test_pii_thresholds_hold_on_unseen_examples(spark):
    """Thresholds come from examples for and against; on newly drawn ones of each way of writing, and of all of them, they keep their precision."""
    model, thresholds = pii._learned(spark)
    right, chosen, there = {}, {}, {}
    for style in range(len(pii._STYLES)):
        rows = pii._examples(style, 60, seed=900 + style)
        assert {(k, y) for k, *_, y in rows} == {(k, y) for k in pii._FOR for y in (0, 1)}
        x, y = pii._measured(spark, rows)
        p = model.probability(x)
        for k in pii._FOR:
            own = x[:, 0] == k
            hit = own & (p >= thresholds[k])
            right[k] = right.get(k, 0) + int(y[hit].sum())
            chosen[k] = chosen.get(k, 0) + int(hit.sum())
            there[k] = there.get(k, 0) + int(y[own].sum())
    for k in pii._FOR:
        assert right[k] >= 0.98 * chosen[k] and right[k] >= 0.75 * there[k]


def test_pii_in_sentences(spark):
    """Texts that the examples' generator didn't write."""
    good = ["Please call our office: 212-555-0199 before noon.", "Her mobile 646.555.0123 rings.", "Reach me at jane_doe (at) mail (dot) example.", "Tax number, social security: 321-54-9876 on file.", "Pay to IBAN: DE44 5001 0517 5407 3249 31, thanks.", "Host address: 2001:db8:85a3:0:0:8a2e:370:7334 answered."]
    bad = ["Version 3.10.255 of page 12 from 2024-05-06.", "Order 4711-0815-99 costs 1,299.00 EUR.", "It was 12:30:45 on 01.02.2003, 100 kg.", "We met (at) noon.", "Part AB12 C3D4 E5F6 in stock.", "Score 10:09:08:07:06:05:04 at the end."]
    rows = [(i, t, 0) for i, t in enumerate(good + bad)]
    got = {r["doc_id"]: r["n_extra"] for r in pii.find_pii(frame(spark, rows)).collect()}
    assert sum(got[i] == 1 for i in range(len(good))) >= 5 and not any(got[i] for i in range(len(good), len(rows)))


def test_redaction_keeps_columns(spark):
    rows = [(1, "a@b.org and +1 (555) 555-1234!", 7), (2, None, 8), (None, "é 10.0.0.1", 9)]
    df = frame(spark, rows).withColumnRenamed("n", "base").withColumnRenamed("doc_id", "row")
    assert sorted(map(str, map(tuple, pii.redact(df).collect()))) == sorted(map(str, [(1, "[email] and [phone]!", 7), (2, None, 8), (None, "é [ip]", 9)]))


def test_trees_learn_and_flatten():
    r = np.random.default_rng(9)
    x = r.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = trees.train(x[:1500], y[:1500], trees=40, depth=3)
    assert ((m.probability(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.95


SF = "/root/testdata/sf0.1"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def held_out_accuracy(spark, scored, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label)
    rows = scored.where("held_out").join(labels, "doc_id").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and 0 <= r["score"] <= 1 for r in rows)
    return np.array([(r[label], r["predicted"]) for r in rows])


@needs_tables
def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = held_out_accuracy(spark, toxicity.toxicity(docs, labels), "toxic")
    assert got[got[:, 0] == 1, 1].mean() > 0.85 and got[got[:, 0] == 0, 1].mean() < 0.01


@needs_tables
def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = held_out_accuracy(spark, quality.quality(docs, labels), "quality")
    assert got[got[:, 0] == 1, 1].mean() > 0.97 and got[got[:, 0] == 0, 1].mean() < 0.1


@pytest.mark.parametrize("score, label", [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_scores_of_odd_rows(spark, score, label):
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    assert {r["score"] for r in score(frame(spark), none).collect()} == {0.0}
    some = spark.createDataFrame([(i, int(i % 2)) for i in range(60)] + [(None, 1), (70, None)], f"doc_id long, {label} int")
    docs = [(i, "you idiot scum " * 5 + f"w{i} v{i}" if i % 2 else f"a fine day {i} in may", 0) for i in range(60)] + CASES
    got = score(frame(spark, docs), some).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got)
    assert score(frame(spark, []), some).count() == 0


def test_contexts_of_the_whole_corpus(spark):
    """Distinct words before each word, by brute force: of the vocabulary, any other, or none at the beginning."""
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["ab", "Cd", "ef", "gh", "x1y", "zz"]) for _ in range(r.randint(0, 30))), 0) for i in range(300)] + CASES
    names = ["ab", "cd", "ef", "the"]
    hashes = {n: int(h[0]) for n, h in zip(names, toxicity.words_of(names))}
    order = sorted(names, key=hashes.get)
    want = {n: set() for n in names}
    for _, t, _ in rows:
        before = None
        for w in re.findall(r"[a-z\x80-\U0010ffff]+", (t or "").translate(ASCII_LOWER)):
            if w in want:
                want[w].add(before)
            before = w if w in want else "other"
    got = toxicity.continuations(frame(spark, rows), np.array([hashes[n] for n in order], np.uint64))
    assert got.tolist() == [len(want[n]) for n in order]
    assert not toxicity.continuations(frame(spark, []), np.array([1], np.uint64)).any()


def test_classes_back_off_to_the_corpus():
    """An expression that doesn't tell the classes apart counts for neither; one that does counts by its classes' own probabilities."""
    r = random.Random(1)
    common = [f"w{c}" for c in "abcdefghijklmnop"]
    text = lambda: [r.choice(common) for _ in range(30)]
    texts = [" ".join(text() + (["vile"] if k % 2 else ["kind"])) for k in range(120)]
    words, y = toxicity.words_of(texts), np.arange(120) % 2
    vocabulary = toxicity._vocabulary(words)
    m = toxicity.Model(*toxicity._language_models(words, y, vocabulary, np.ones(len(vocabulary))), np.zeros(5), np.zeros(4), np.ones(4))
    of = {w: float(m.word[np.searchsorted(vocabulary, toxicity.words_of([w])[0][0])]) for w in ("vile", "kind", *common)}
    assert of["vile"] > 3 and of["kind"] < -3 and not any(of[w] for w in common)
    assert np.count_nonzero(m.context) <= 2


def _letters(k):
    return "".join(chr(97 + int(d)) for d in str(k))


def test_all_labelled_rows_are_learned_from(spark):
    """Each of 300 toxic words is in 20 labelled rows; only in all of them together are they evidence."""
    r = random.Random(6)
    rows = [(i, " ".join("q" + _letters(r.randrange(5000)) for _ in range(13 - i % 2)) + (f" vile{_letters(i // 2 % 300)}" if i % 2 else ""), 0) for i in range(12000)]
    some = spark.createDataFrame([(i, i % 2) for i, _, _ in rows], "doc_id long, toxic int")
    got = toxicity.toxicity(frame(spark, rows), some).where("held_out").collect()
    assert len(got) > 2000
    assert np.mean([x["predicted"] for x in got if x["doc_id"] % 2]) > 0.95 and np.mean([x["predicted"] for x in got if x["doc_id"] % 2 == 0]) < 0.05


def test_learned_from_and_its_counts(spark):
    """All labelled rows but held-out ones, near copies too, equal texts of a class once; counts by brute force, however often tasks give up what they hold."""
    r = random.Random(8)
    rows = [(i, " ".join("q" + _letters(r.randrange(200)) if r.random() < 0.2 else "q" + _letters(r.randrange(10**6)) for _ in range(r.randint(9, 40))) + (" foul play" if i % 3 == 1 else " fair play") * (i % 5 > 0), 0) for i in range(400)]
    copied = " ".join("z" + _letters(k) for k in range(200))
    rows += [(i, copied, 0) for i in range(400, 440)] + [(i, copied + " more", 0) for i in range(440, 460)] + rows[:50] + [(i, "", 0) for i in range(460, 480)]
    known = {i: i % 3 % 2 for i in range(480) if i % 7}
    some = spark.createDataFrame([*known.items(), (1, None), (None, 1), (999, 1), (3, 2), *list(known.items())[:30]], "doc_id long, toxic int")
    texts = toxicity.learned_from(frame(spark, rows), some)
    got = [(x["text"], x["y"]) for x in texts.collect()]
    want = {(t.translate(ASCII_LOWER), known[i]) for i, t, _ in rows if i in known and zlib.crc32(str(i).encode()) % 5}
    assert sorted(got) == sorted(want) and {t for t, _ in got} >= {copied, copied + " more", ""}
    words = toxicity.words_of([t for t, _ in got])
    vocabulary, count = toxicity._word_counts(texts)
    assert vocabulary.tolist() == toxicity._vocabulary(words).tolist()
    y = np.array([y for _, y in got])
    contexts = np.arange(len(vocabulary)) + 1.0
    want = toxicity._language_models(words, y, vocabulary, contexts)
    code = {(x["text"], x["y"]): x["code"] for x in texts.collect()}
    part = np.array([code[x] // 2 for x in got])
    for k, c in enumerate(toxicity._all_counts(texts, vocabulary, count, contexts)):
        use = part != k  # the last has no part left out
        want = toxicity._language_models([w for w, u in zip(words, use) if u], y[use], vocabulary, contexts)
        assert all(np.allclose(a, b) for a, b in zip(want, toxicity._estimated(c, vocabulary, contexts)))
        assert np.count_nonzero(want[1]) and len(want[3])


def test_pairs_meet_in_bytes():
    r = np.random.default_rng(2)
    v = 5000
    sent, merged = {}, []
    parts = []
    for _ in range(3):
        keys, n = np.unique(np.concatenate((r.integers(0, v * v, 4000), r.integers(0, 900, 5000))), return_counts=True)
        parts += toxicity._split(keys, n, v, v).to_pylist()
        for k, c in zip(keys.tolist(), n.tolist()):
            sent[k] = sent.get(k, 0) + c
    parts.sort(key=lambda x: x["bucket"])
    for keys, n in toxicity._merged(iter([pa.RecordBatch.from_pylist(parts[:2000]), pa.RecordBatch.from_pylist(parts[2000:])])):
        merged += zip(keys.tolist(), n.tolist())
    assert len(merged) == len(sent) and dict(merged) == sent


def test_toxic_rows_go(spark):
    some = spark.createDataFrame([(i, int(i % 2)) for i in range(80)], "doc_id long, toxic int")
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    docs = [(i, " ".join(word() for _ in range(30)) + (" idiot scum" if i % 2 else " friend"), i) for i in range(80)]
    kept = toxicity.without_toxic(frame(spark, docs), some).collect()
    assert {r["doc_id"] for r in kept} == {i for i in range(0, 80, 2)} and kept[0].asDict().keys() == {"doc_id", "text", "n"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "pii", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.count(), corpus_pipeline.written(stage(spark, docs, sf), name)
        assert docs.columns == columns and docs.count() <= before
    rows = [(r["doc_id"], r["text"], 0) for r in docs.collect()]
    assert len({t.translate(ASCII_LOWER) for _, t, _ in rows}) == len(rows)
    assert not any(rule_spans(t) for _, t, _ in rows)
    sets = [shingles(t, 5) for _, t, _ in rows]
    assert not any(a and 100 * len(a & b) >= 80 * len(a | b) for k, a in enumerate(sets) for b in sets[:k])
    assert corpus_pipeline.run(spark, sf).select("doc_id").distinct().count() == len(rows)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_pipeline_of_repeated_rows_and_of_nothing(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    once = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()}
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    for name, d in (("twice", docs.unionByName(docs)), ("none", docs.limit(0))):
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/twice").where("piece = 0").groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in got} == once and {r["count"] for r in got} == {1}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_many_spans_in_one_text(spark):
    """A hundred thousand base spans, and as many candidates, in one text each."""
    emails = "".join(f"a{k}@b.org é " for k in range(100_000))
    numbers = "".join(f"call {100 + k % 800}-10-{1000 + k % 9000}, " for k in range(100_000))
    mixed = "".join(f"mail x{k}@y.net or call 555-{100 + k % 800}-{1000 + k % 9000}. " for k in range(20_000))
    rows = [(1, emails, 0), (2, numbers, 0), (3, mixed, 0)]
    for doc_id, text, n in rows:
        one = frame(spark, [(doc_id, text, n)])
        began = time.time()
        found = pii.find_pii(one).first()
        want = rule_spans(text)
        assert found["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert len(found["base"]) + found["n_extra"] >= (0 if doc_id == 2 else 20_000)
        clean = pii.redact(one).first()["text"]
        spans = sorted([(s.s, s.e, pii.KINDS[s.k]) for s in [*found["base"], *found["extra"]]])
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        at, out = 0, []
        for s, e, kind in spans:
            out += [text[at:s], f"[{kind}]"]
            at = e
        assert clean == "".join(out) + text[at:]
        assert time.time() - began < 60


def test_overlaps_equal_brute_force(spark):
    r = random.Random(31)
    rows = []
    for n in range(150):
        spans = [(s := r.randint(0, 40 if n % 2 else 4000), s + r.randint(1, 12 if n % 2 else 400), r.randint(4, 8), r.choice([0.0, 0.5, r.random()])) for _ in range(r.randint(0, 60))]
        base = [(r.randint(0, 3), s := r.randint(0, 4000), s + r.randint(1, 30)) for _ in range(r.randint(0, 8))]
        rows.append((n, spans, base))
    df = spark.createDataFrame(rows, "n int, spans array<struct<s: int, e: int, k: int, z: double>>, base array<struct<k: int, s: int, e: int>>")
    free = pii._apart_from("base", "transform(spans, x -> named_struct('k', x.k, 's', x.s, 'e', x.e, 'm', cast(x.z as string)))")
    got = {x["n"]: x for x in df.selectExpr("n", f"{pii._best('spans')} as best", f"{free} as free").collect()}
    for n, spans, base in rows:
        meets = lambda a, b: a[0] < b[1] and b[0] < a[1]
        rank = lambda x: (-x[3], x[0], -x[1], x[2])
        assert [tuple(x) for x in got[n]["best"]] == sorted(c for c in spans if not any(meets(b, c) and rank(b) < rank(c) for b in spans))
        assert sorted((x.s, x.e, x.k) for x in got[n]["free"]) == sorted(c[:3] for c in spans if not any(meets(c, b[1:]) for b in base))


def test_running_values(spark):
    r = random.Random(8)
    rows = [([r.randint(-9, 9) for _ in range(n)],) for n in (0, 1, 2, 3, 4, 5, 15, 16, 17, 1000)]
    got = spark.createDataFrame(rows, "v array<int>").selectExpr("v", f"{pii._scan('v', 'x + y', '0')} as total", f"{pii._scan('v', 'greatest(x, y)', '-99')} as most").collect()
    for x in got:
        assert x["total"] == list(itertools.accumulate(x["v"])) and x["most"] == list(itertools.accumulate(x["v"], max))
