"""How far each source's words are from those of other sources, and from those of its language.

Document frequencies of all terms are counted into a count-min sketch, the tables of all tasks are merged, and a
term that the sketch puts under ``LEAST_DOCS`` documents of a language is left out before anything is
shuffled: sketches never underestimate, so no kept term goes. Survivors are counted exactly by their strings;
those that still have too few documents go then. Pairs of sources are compared through a
sparse join: only terms that both sources have meet; what one of them has alone is summed by how often
it occurs there (terms of one count have one share), and what neither has is one product.

Each count c of a group with N occurrences of kept terms, V terms being kept, gives the share
p = 1 + floor(10^9 (c + 1) / (N + V)); shares p against q diverge by floor((p - q)^2 / q). All of it
is whole numbers.

Defined cases: null texts, languages and sources are empty strings; every language and source that
occurs is a group, even without terms; repeated rows count each; with no kept term a pair has the value
0; an empty table gives an empty one; columns other than the three named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import for_workers, partitions, written
from .key_sets import distinct
from .word_spans import Words, word_spans
from .words import LOWER, NO_LETTER, mix, word_hashes

#: Documents of its language that a kept term is in at least; ranks of terms that are reported.
LEAST_DOCS, TOP = 3, 200
#: Rows of the sketch; its cells a document's worth of terms, and the bounds of its width (3 rows of 2^24 cells are 48 MB). Cells stop at LEAST_DOCS.
DEPTH, CELLS, WIDTHS = 3, 32, (1 << 16, 1 << 24)
#: Cells of a sketch that travel as one row.
CHUNK = 1 << 16
#: Distinct terms of groups that a task gathers before it sends their counts.
GATHERED = 1 << 20
#: Meetings of two sources in a term that are worked on at once.
PAIRS = 1 << 20
#: Bytes of text that are read together: codes and hashes of all their words are held at once.
AT_ONCE = 1 << 21
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _rows(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    for_workers(docs.sparkSession)
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))


def _cells(lang: np.ndarray, term: np.ndarray, width: int) -> list[np.ndarray]:
    """The cell of each term of a language in every row of the sketch."""
    key = mix(term ^ mix(lang))
    return [(mix(key + odd) & np.uint64(width - 1)).astype(np.int64) for odd in _ODD[:DEPTH]]


def _hashed_names(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A code of each name, and a hash by code."""
    coded = names.dictionary_encode()
    return coded.indices.to_numpy(), np.array([word_hashes([(x or "").encode()])[0] for x in coded.dictionary.to_pylist()], np.uint64)


def _document_terms(words: Words, codes: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, code and count of the distinct terms of each text."""
    text = np.repeat(np.arange(len(words.begin) - 1), np.diff(words.begin))
    key, at = distinct(text * terms + codes)
    return key // max(terms, 1), key % max(terms, 1), np.bincount(at, minlength=len(key))


def _by_code(codes: np.ndarray, strings: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Codes of terms only (separators have codes too), and the terms' bytes."""
    used, again = np.unique(codes, return_inverse=True)
    return again, strings.take(pa.array(used)).to_pylist()


def sketch(rows: DataFrame, width: int) -> np.ndarray:
    """The merged sketch of all texts: in how many documents of its language a term is, at most, up to LEAST_DOCS."""

    def sent(chunk: int, cells: np.ndarray) -> pa.RecordBatch:
        four = cells.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)  # two bits a cell
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([four.sum(axis=1, dtype=np.uint8).tobytes()], pa.binary())], ["chunk", "cells"])

    def received(raw: bytes) -> np.ndarray:
        return (np.frombuffer(raw, np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8) & np.uint8(3)).ravel()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((DEPTH, width), np.uint8)
        for batch in batches:
            lang, names = _hashed_names(batch.column("lang"))
            for words in word_spans(batch.column("text"), NO_LETTER, LOWER, AT_ONCE):
                codes, terms = _by_code(*words.coded())
                text, code, _ = _document_terms(words, codes, len(terms))
                # A term of a language is hashed once a run.
                key, at = distinct(lang[words.first + text].astype(np.int64) * len(terms) + code)
                times = np.minimum(np.bincount(at, minlength=len(key)), LEAST_DOCS)
                for row, cells in zip(table, _cells(names[key // max(len(terms), 1)], word_hashes(terms)[key % max(len(terms), 1)], width)):
                    order = np.argsort(cells)
                    first = np.flatnonzero(np.diff(cells[order], prepend=-1))
                    cell = cells[order][first]
                    if len(cell):
                        row[cell] = np.minimum(row[cell] + np.add.reduceat(times[order], first), LEAST_DOCS)
        parts = table.reshape(-1, min(CHUNK, width))
        used = np.flatnonzero(parts.any(axis=1))
        for k in used.tolist():
            yield sent(k, parts[k])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            for k, raw in zip(batch.column("chunk").to_pylist(), batch.column("cells").to_pylist()):
                cells = received(raw)
                if k == now:
                    held = np.minimum(held + cells, LEAST_DOCS).astype(np.uint8)
                    continue
                if held is not None:
                    yield sent(now, held)
                now, held = k, cells
        if held is not None:
            yield sent(now, held)

    made = rows.select("lang", "text").mapInArrow(count, "chunk int, cells binary")
    merged = made.repartition(partitions(rows), "chunk").sortWithinPartitions("chunk").mapInArrow(merge, "chunk int, cells binary").toArrow()  # DEPTH * width / 4 bytes
    out = np.zeros((DEPTH * width // min(CHUNK, width), min(CHUNK, width)), np.uint8)
    for k, raw in zip(merged["chunk"].to_pylist(), merged["cells"].to_pylist()):
        out[k] = received(raw)
    return out.reshape(DEPTH, width)


def _survivors(rows: DataFrame, merged: Broadcast, width: int) -> DataFrame:
    """lang, source, term, n (occurrences) and docs of the terms that the sketch doesn't rule out, summed within each task's runs of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(tables: list[pa.Table]) -> pa.Table:
            return pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(["lang", "source", "term", "n", "docs"])

        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            lang, names = _hashed_names(batch.column("lang"))
            langs, sources = batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
            of_source = sources.indices.to_numpy()
            for words in word_spans(batch.column("text"), NO_LETTER, LOWER, AT_ONCE):
                codes, terms = _by_code(*words.coded())
                if not terms:
                    continue
                text, code, n = _document_terms(words, codes, len(terms))
                row = words.first + text
                hashes = word_hashes(terms)
                # A term of a language is looked up once a run.
                key, again = distinct(lang[row].astype(np.int64) * len(terms) + code)
                often = np.min([t[c] for t, c in zip(merged.value, _cells(names[key // len(terms)], hashes[key % len(terms)], width))], axis=0) >= LEAST_DOCS
                stay = often[again]
                key, again = distinct((lang[row[stay]].astype(np.int64) * len(sources.dictionary) + of_source[row[stay]]) * len(terms) + code[stay])
                group = key // len(terms)
                strings = pa.array(terms, pa.binary()).take(pa.array(key % len(terms)))
                held.append(pa.table([
                    langs.dictionary.take(pa.array(group // len(sources.dictionary))), sources.dictionary.take(pa.array(group % len(sources.dictionary))), strings,
                    pa.array(np.bincount(again, n[stay], len(key)).astype(np.int64)), pa.array(np.bincount(again, minlength=len(key)).astype(np.int64))], ["lang", "source", "term", "n", "docs"]))
                size += len(key)
            if size >= GATHERED:
                held = [summed(held)]
                if held[0].num_rows > size // 2:  # little repeats: send it
                    yield from _utf8(held[0])
                    held = []
                size = sum(t.num_rows for t in held)
        if held:
            yield from _utf8(summed(held))

    return rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def _utf8(table: pa.Table) -> Iterator[pa.RecordBatch]:
    at = table.schema.get_field_index("term")
    yield from table.set_column(at, "term", table["term"].cast(pa.string())).combine_chunks().to_batches(1 << 16)


def _share(count: str | Column, total: str | Column) -> Column:
    """1 + floor(10^9 (count + 1) / total), by long division in three steps of 1000: no product leaves 64 bits under 9 * 10^15 occurrences."""
    count, total = (F.col(c) if isinstance(c, str) else c for c in (count, total))
    whole, rest = F.expr("0L"), count + 1
    for step in range(4):
        if step:
            rest = rest * 1000
        whole = whole * (1000 if step else 1) + _div(rest, total)
        rest = rest % total
    return whole + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _far(p: str | Column, q: str | Column) -> Column:
    p, q = (F.col(c) if isinstance(c, str) else c for c in (p, q))
    return _div((p - q) * (p - q), q)


def divergence(docs: DataFrame, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: every source against each other one of its language (``pair``), and its ``top`` terms against the language (``term``)."""
    spark = docs.sparkSession
    rows = _rows(docs, lang_col, source_col, text_col)
    groups = written(rows.groupBy("lang", "source").agg(F.count("*").alias("docs")), "groups")
    n_docs = groups.agg(F.sum("docs")).first()[0] or 0
    width = min(max(WIDTHS[0], 1 << math.ceil(math.log2(max(n_docs * CELLS, 1)))), WIDTHS[1])
    merged = spark.sparkContext.broadcast(sketch(rows, width))
    # One shuffle, by language and term; a term's row holds its count in each source.
    counted = _survivors(rows, merged, width).repartition(partitions(docs), "lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counted.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("found"))
    terms = written(terms.where(F.col("docs") >= LEAST_DOCS).drop("docs"), "terms")

    # One row a language or a group from here to the pairs: N of each, V of the language, the share of a term that doesn't occur.
    langs = terms.groupBy("lang").agg(F.count("*").alias("V"), F.sum("in_lang").alias("N_lang"))
    sums = terms.select("lang", F.explode("found").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("N"), F.count("*").alias("own"))
    facts = groups.select("lang", "source").join(langs, "lang", "left").join(sums, ["lang", "source"], "left").fillna(0, ["V", "N_lang", "N", "own"])
    facts = written(facts.withColumn("total", F.greatest(F.col("N") + F.col("V"), F.lit(1))).withColumn("none", _share(F.lit(0).cast("long"), F.col("total"))), "facts")
    return _pairs(facts, terms).unionByName(_terms(facts, terms, top))


def _pairs(facts: DataFrame, terms: DataFrame) -> DataFrame:
    """The ``pair`` rows: both terms' own, one's alone by share, and neither's."""
    one, other = (facts.select("lang", *(F.col(c).alias(f"{c}_{side}") for c in ("source", "own", "none")), *(["V"] if side == "a" else [])) for side in "ab")
    pairs = written(one.join(other, "lang").where("source_a <> source_b"), "pairs")
    # Terms of one count within a group have one share.
    by_count = terms.select("lang", F.explode("found").alias("x")).groupBy("lang", F.col("x.source").alias("source"), F.col("x.n").alias("n")).agg(F.count("*").alias("terms"))
    by_share = written(by_count.join(facts.select("lang", "source", "total"), ["lang", "source"]).select("lang", "source", "terms", _share("n", "total").alias("p")), "shares")
    mine = by_share.withColumnRenamed("source", "source_a").join(pairs.select("lang", "source_a", "source_b", "none_b"), ["lang", "source_a"])
    mine = mine.groupBy("lang", "source_a", "source_b").agg(F.sum(F.col("terms") * _far("p", "none_b")).alias("mine"))
    theirs = by_share.withColumnRenamed("source", "source_b").join(pairs.select("lang", "source_a", "source_b", "none_a"), ["lang", "source_b"])
    theirs = theirs.groupBy("lang", "source_a", "source_b").agg(F.sum(F.col("terms") * _far("none_a", "p")).alias("theirs"))
    # The sources that share a term stand in its row: they meet there, each two once, for both directions.
    of_lang = facts.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("source", F.struct("total", "none")))).alias("of"))
    own = terms.join(of_lang, "lang").select("lang", F.transform("found", lambda x: F.struct(x["source"].alias("source"), x["n"].alias("n"), F.col("of")[x["source"]].alias("of"))).alias("found"))
    met = _meetings(own).groupBy("lang", "source_a", "source_b").agg(F.sum("shared").alias("shared"), F.sum("ab").alias("ab"), F.sum("ba").alias("ba"))
    met = met.withColumn("way", F.explode(F.array(F.lit(True), F.lit(False))))
    both = met.select("lang", *(F.when(F.col("way"), F.col(f"source_{x}")).otherwise(F.col(f"source_{y}")).alias(f"source_{x}") for x, y in ("ab", "ba")), "shared", F.when(F.col("way"), F.col("ab")).otherwise(F.col("ba")).alias("both"))
    key = ["lang", "source_a", "source_b"]
    out = pairs.join(mine, key, "left").join(theirs, key, "left").join(both, key, "left").fillna(0, ["mine", "theirs", "both", "shared"])
    value = F.col("mine") + F.col("theirs") + F.col("both") + (F.col("V") - F.col("own_a") - F.col("own_b") + F.col("shared")) * _far("none_a", "none_b")
    out = out.select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), value.alias("value"))
    return _ranked(out)


def _meetings(own: DataFrame) -> DataFrame:
    """lang, source_a, source_b, shared, ab, ba: for each two sources, summed within a batch of terms, how many terms both have, and what these change in either direction."""

    def far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // q

    def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
        """``_share`` in arrays."""
        whole, rest = np.divmod(count + 1, total)
        for _ in range(3):
            more, rest = np.divmod(rest * 1000, total)
            whole = whole * 1000 + more
        return whole + 1

    def summed(keys: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        """Exact sums by key of at most PAIRS whole numbers: halves of 32 bits, whose sums a double holds."""
        low, high = values & 0xFFFFFFFF, values >> 32
        return (np.bincount(keys, high, n).astype(np.int64) << 32) + np.bincount(keys, low, n).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column("lang").dictionary_encode()
            found = batch.column("found")
            begin, entries = found.offsets.to_numpy().astype(np.int64), found.values
            source = entries.field("source").dictionary_encode()
            names = np.array(source.dictionary.to_pylist(), object)
            rank = np.empty(len(names), np.int64)
            rank[np.argsort([n.encode() for n in names], kind="stable") if len(names) else []] = np.arange(len(names))
            place, none = rank[source.indices.to_numpy()], entries.field("of").field("none").to_numpy()
            p = shares(entries.field("n").to_numpy(), entries.field("of").field("total").to_numpy())
            by_rank, of_lang, sizes = names[np.argsort(rank)], lang.indices.to_numpy().astype(np.int64), np.diff(begin)
            n = len(lang.dictionary) * len(names) ** 2
            total = np.zeros((3, n), np.int64)
            for size in np.unique(sizes[sizes > 1]).tolist():
                i, j = np.triu_indices(size, 1)
                rows = np.flatnonzero(sizes == size)
                for some in np.array_split(rows, -(-len(rows) * len(i) // PAIRS)):
                    a, b = ((begin[some][:, None] + x).ravel() for x in (i, j))
                    a, b = np.where(place[a] < place[b], a, b), np.where(place[a] < place[b], b, a)
                    key = (np.repeat(of_lang[some], len(i)) * len(names) + place[a]) * len(names) + place[b]
                    total[0] += np.bincount(key, minlength=n)
                    for row, x, y in ((1, a, b), (2, b, a)):
                        total[row] += summed(key, far(p[x], p[y]) - far(p[x], none[y]) - far(none[x], p[y]), n)
            used = np.flatnonzero(total[0])
            which, a, b = used // len(names) ** 2 if len(names) else used, used // max(len(names), 1) % max(len(names), 1), used % max(len(names), 1)
            yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(which)), pa.array(by_rank[a].tolist(), pa.string()), pa.array(by_rank[b].tolist(), pa.string()), *(pa.array(t[used]) for t in total)], ["lang", "source_a", "source_b", "shared", "ab", "ba"])

    return own.mapInArrow(run, "lang string, source_a string, source_b string, shared long, ab long, ba long")


def _terms(facts: DataFrame, terms: DataFrame, top: int) -> DataFrame:
    """The ``term`` rows: what a source has more of than its language."""
    own = terms.select("lang", "term", "in_lang", F.explode("found").alias("x")).select("lang", "term", "in_lang", "x.source", "x.n")
    shares = own.join(facts.select("lang", "source", "V", "N_lang", "total"), ["lang", "source"])
    shares = shares.select("lang", "source", "term", _share("n", "total").alias("p"), _share(F.col("in_lang"), F.col("N_lang") + F.col("V")).alias("q"))
    out = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _far("p", "q").alias("value"))
    return _ranked(out).where(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
