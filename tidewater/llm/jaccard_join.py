"""N-gram Jaccard self-join by universe partition and the pigeonhole principle.

Sets are distinct word shingles. Equal sets are one node, named by 64 bits of their digest; where
different sets have one name by a second 64 bits, these are renamed by all 128. Sizes fall into bands; a band's larger size bounds the symmetric difference of any linking pair by H. The
universe of shingles is hashed into segments, and two linking sets agree on enough of them:

* wide bands: m = H + 1 + x segments. A set whose own partners differ from it by at most h <= H
  agrees with each on at least m - h segments, so it may leave out its m - h - 1 dearest ones
  (fewest shingles first: they are the most common, empty segments above all; ties by content).
  The cheapest segment that a linking pair agrees on is never left out by either.
* narrow bands (H up to ``DELETIONS``): ceil((H + 1) / 2) segments, of which one differs by at
  most one shingle; each set is indexed under the segment and all its one-deletion neighbours.

Sets that share a signature form a bucket. Before sets meet, ``WORDS`` 64-bit words of parities
(of the counts of shingles by hash) bound their difference from below, exactly. Not all pairs of a
bucket are verified, and yet no link between components is lost: first each set is held
against the one leader it shares most buckets with; then, ``ROUNDS`` times, against leaders drawn
anew by each bucket that still holds several components; at last, in such buckets, the sets outside
the bucket's commonest component against those of other components. Pairs within one component
need no test. Every test counts the common shingles of the whole sets, told apart by 128 bits.

Defined cases: a null or empty text, or one without words, has an empty set and links with
nothing; a text of fewer words than a shingle has its whole sequence as one; repeated rows link,
each row being a document of its own; a null identifier links with nothing and gets a null
component; one identifier on several texts is a document for each; an empty table gives an empty
one; columns other than the two named are passed on by ``dedup`` alone, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.tables import collecting, forget

from . import library_ids
from .common import kept_rows, two_columns, written
from .words import checked_shingle_sets, mix, shingle_sets

#: Largest H for which one-deletion neighbourhoods are indexed.
DELETIONS = 3
#: Growth of the sizes of a band, and the share of segments that a set may leave out.
GROWTH, SPARE = 1.5, 16
#: Rounds of newly drawn leaders; words of parities.
ROUNDS, WORDS = 2, 8
_K = np.uint64(0x9E3779B97F4A7C15)
_K2 = np.uint64(0xC2B2AE3D27D4EB4F)


class Bands:
    """Band k holds pairs whose larger set has sizes low[k] .. high[k]."""

    def __init__(self, percent: int, largest: int):
        self.low, self.high, self.segments, self.spare, self.deletion = [], [], [], [], []
        low = 1
        while low <= largest:
            high = max(low, int(low * GROWTH))
            h = (100 - percent) * 2 * high // (100 + percent)
            deletion = 0 < h <= DELETIONS
            spare = 0 if h <= DELETIONS else max(1, h // SPARE)  # of a set whose partners may differ by h = H
            self.low.append(low)
            self.high.append(high)
            self.deletion.append(deletion)
            self.segments.append(-(-(h + 1) // 2) if deletion else h + 1 + spare)
            self.spare.append(spare)
            low = high + 1
        self.percent = percent

    def of(self, n: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each band with the positions of the sizes that take part in it."""
        for k, (low, high) in enumerate(zip(self.low, self.high)):
            at = np.flatnonzero((n <= high) & (100 * n >= self.percent * low))
            if len(at):
                yield k, at


def signatures(sets: np.ndarray, begin: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(set's position, 64-bit signature) of all sets."""
    n = np.diff(begin)
    bands = Bands(percent, int(n.max(initial=0)))
    owners, found = [], []
    place = mix(sets ^ _K)
    for k, at in bands.of(np.where(n > 0, n, np.iinfo(np.int64).max)):
        m, size = bands.segments[k], n[at]
        own = np.repeat(np.arange(len(at)), size)
        element = np.arange(len(own)) + np.repeat(begin[at] - (np.cumsum(size) - size), size)
        segment = (place[element] % np.uint64(m)).astype(np.int64)
        slot = own * m + segment
        value = mix(place[element] + _K2)
        content = np.zeros(len(at) * m, np.uint64)
        np.add.at(content, slot, value)
        tag = mix((np.arange(m, dtype=np.uint64) + np.uint64(k << 32) + np.uint64(1)) * _K)
        if bands.deletion[k]:
            sig = mix(content + np.tile(tag, len(at)))
            less = mix(content[slot] - value + tag[segment])
            owners += [np.repeat(at, m), at[own]]
            found += [sig, less]
            continue
        sig = mix(content + np.tile(tag, len(at))).reshape(len(at), m)
        if bands.spare[k]:
            count = np.bincount(slot, minlength=len(at) * m)
            # The dearest first: by shingles in the segment, then by content.
            dear = (np.minimum(count, 255).astype(np.uint64) << np.uint64(56)).reshape(len(at), m) | (sig >> np.uint64(8))
            sig = np.take_along_axis(sig, np.argsort(dear, axis=1), axis=1)
            partner = np.minimum(bands.high[k], 100 * size // percent)
            differ = (100 - percent) * (size + partner) // (100 + percent)
            kept = np.arange(m)[None] >= (m - 1 - differ)[:, None]
            owners.append(np.repeat(at, kept.sum(axis=1)))
            found.append(sig[kept])
            continue
        owners.append(np.repeat(at, sig.shape[1]))
        found.append(sig.ravel())
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(owners), np.concatenate(found)


def parities(sets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sets x WORDS: bit by bit, whether an odd number of shingles hash there. Two sets differ at least by the bits that differ."""
    bits = 64 * WORDS
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    odd = np.bincount(owner * bits + (mix(sets + _K2) % np.uint64(bits)).astype(np.int64), minlength=(len(begin) - 1) * bits) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8").reshape(-1, WORDS)


def _shingled(words: int, percent: int):
    """Per row: id, size, node and check (two halves of the set's digest), parities and signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library_ids.release()  # of an operator that this worker served before
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.schema.names[2:]  # the row's key, where it is asked for
            for first, sets, begin in shingle_sets(batch.column("text"), words):
                owner, sig = signatures(sets, begin, percent)
                order = np.lexsort((sig, owner))
                owner, sig = owner[order], sig[order].view(np.int64)
                fresh = np.ones(len(sig), bool)
                fresh[1:] = (owner[1:] != owner[:-1]) | (sig[1:] != sig[:-1])
                owner, sig = owner[fresh], sig[fresh]
                ends = np.searchsorted(owner, np.arange(len(begin)))
                n = len(begin) - 1
                odd = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * WORDS), pa.array(parities(sets, begin).ravel()))
                listed = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(sig))
                yield pa.RecordBatch.from_arrays([ids.slice(first, n), pa.array(np.diff(begin)), *_names(sets, begin), odd, listed, *(batch.column(c).slice(first, n) for c in keys)], ["doc_id", "n_shingles", "node", "check", "odd", "signatures", *keys])

    return run


def _names(sets: np.ndarray, begin: np.ndarray) -> list[pa.Array]:
    """node and check of each set."""
    raw = b"".join(hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() for a, b in zip(begin.tolist(), begin[1:].tolist()))
    return [pa.array(x) for x in np.frombuffer(raw, "<i8").reshape(-1, 2).T.copy()]


def _sets(words: int):
    """Per row: node, check and its shingles: all first hashes, then all second ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets, checks, begin in checked_shingle_sets(batch.column("text"), words):
                both = [sets[a:b].tobytes() + checks[a:b].tobytes() for a, b in zip(begin.tolist(), begin[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*_names(sets, begin), pa.array(both, pa.binary())], ["node", "check", "shingles"])

    return run


def _halves(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """First and second hashes of the sets of a column, read where they lie."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], "<i8")[column.offset : column.offset + len(column) + 1].tolist()
    data = column.buffers()[2] or b""
    return [tuple(np.frombuffer(data, "<u8", (b - a) // 8, a).reshape(2, -1)) for a, b in zip(offsets, offsets[1:])]


def common(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> int:
    """How many shingles two sets share."""
    if len(x[0]) > len(y[0]):
        x, y = y, x
    if not len(x[0]):
        return 0
    at = np.minimum(np.searchsorted(y[0], x[0]), len(y[0]) - 1)
    return int(((y[0][at] == x[0]) & (y[1][at] == x[1])).sum())


def _linking(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(_halves(batch.column("x")), _halves(batch.column("y"))):
                both = common(x, y)
                keep.append(100 * both >= percent * (len(x[0]) + len(y[0]) - both))
            if any(keep):
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link; distinct on entry."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return written(pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(_linking(percent), "a long, b long"), "links")


def components(links: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels`` (node, component: the least node) after the ``links`` (a, b). Labels are contracted to the least neighbour until no link joins two of them."""
    while True:
        a = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        b = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        edges = links.join(a, "a").join(b, "b").where("ca <> cb").select(F.greatest("ca", "cb").alias("high"), F.least("ca", "cb").alias("low")).distinct()
        step = written(edges.groupBy("high").agg(F.min("low").alias("low")), "contraction")
        if step.isEmpty():
            return labels
        further = step.select(F.col("high").alias("low"), F.col("low").alias("lower"))
        jump = step.join(further, "low", "left").select(F.col("high").alias("component"), F.coalesce("lower", "low").alias("new"))
        labels = written(labels.join(jump, "component", "left").select("node", F.coalesce("new", "component").alias("component")), "labels")


def _plausible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ...) whose sizes and parities leave a link possible."""
    a = sketches.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("odd").alias("oa"))
    b = sketches.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("odd").alias("ob"))
    return pairs.join(a, "a").join(b, "b").where(_may_link(percent)).select(pairs.columns)


def _may_link(percent: int) -> str:
    bits = " + ".join(f"bit_count(oa[{k}] ^ ob[{k}])" for k in range(WORDS))
    return f"100 * least(na, nb) >= {percent} * greatest(na, nb) and {100 + percent} * ({bits}) <= {100 - percent} * (na + nb)"


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) that lie in two components."""
    a = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    b = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    return pairs.join(a, "a").join(b, "b").where("ca <> cb").select(pairs.columns)


def _open(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """sig, node, component, leading (the commonest component of the bucket) in the buckets that hold several."""
    placed = buckets.join(labels, "node")
    sizes = placed.groupBy("sig", "component").agg(F.count("*").alias("n"))
    leading = sizes.groupBy("sig").agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("several")).where("several > 1").select("sig", F.col("top.component").alias("leading"))
    return placed.join(written(leading, "leading"), "sig")


def _ordered(a: str, b: str) -> list:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def _crossing(placed: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Of each open bucket, the sets outside its leading component with those of other components, as far as they may link."""
    known = placed.join(sketches, "node")
    outside = known.where("component <> leading").select("sig", F.col("node").alias("a"), F.col("n").alias("na"), F.col("odd").alias("oa"), F.col("component").alias("ca"))
    inside = known.select("sig", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("odd").alias("ob"), F.col("component").alias("cb"), F.expr("component <> leading").alias("both"))
    pairs = outside.join(inside, (outside["sig"] == inside["sig"]) & F.expr("ca <> cb and (not both or a < b)") & F.expr(_may_link(percent)))
    return pairs.select(*_ordered("a", "b")).distinct()


def link_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of each row: the smallest doc_id reachable over pairs of sets with a Jaccard similarity of at least ``percent`` hundredths."""
    marked, least = _linked(docs, words, percent, id_col, text_col, keyed=False)
    smallest = written(least.groupBy("component").agg(F.min("first").alias("component_id")), "smallest")
    named = least.join(smallest, "component").select("node", "component_id")
    out = marked.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))).alias("component_id"))


def _linked(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str, keyed: bool) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_shingles, node (and ``row``, its key, if ``keyed``) of each row; node, first (its smallest doc_id) and component of each node."""
    with collecting() as made:
        marked, labels = _searched(docs, words, percent, id_col, text_col, keyed)
    forget(docs.sparkSession, made, but=[marked, labels])
    least = marked.where("n_shingles > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    return marked, least.join(labels, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))


def _renamed(df: DataFrame, clashing: DataFrame | None) -> DataFrame:
    """Sets that share a node by chance get one by both halves of their digest."""
    if clashing is None:
        return df
    out = df.join(clashing.hint("merge"), "node", "left")
    return out.withColumn("node", F.when(F.col("clash"), F.xxhash64("node", "check")).otherwise(F.col("node"))).select(df.columns)


def _searched(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str, keyed: bool) -> tuple[DataFrame, DataFrame]:
    """The rows with their nodes, and node and component of the nodes that share a bucket with others."""
    rows = two_columns(docs, id_col, text_col)
    shingled = two_columns(docs, id_col, text_col, keyed).mapInArrow(_shingled(words, percent), "doc_id long, n_shingles long, node long, check long, odd array<long>, signatures array<long>" + ", row binary" * keyed)
    with collecting() as large:
        shingled = written(shingled, "signatures")
    clashing = shingled.groupBy("node").agg(F.min("check").alias("one"), F.max("check").alias("other")).where("one <> other").select("node", F.lit(True).alias("clash"))
    clashing = written(clashing, "clashing")
    clashing = None if clashing.isEmpty() else clashing
    shingled = _renamed(shingled, clashing)
    marked = written(shingled.drop("check", "odd", "signatures"), "marked")
    usable = F.expr("n_shingles > 0 and doc_id is not null")
    filled = shingled.where(usable)

    members = filled.select("node", F.explode("signatures").alias("sig"))
    # Written, here and below, so that a join on a very common signature or component has a plain exchange on either side, which Spark splits.
    shared = written(members.groupBy("sig").agg(F.min("node").alias("leader"), F.max("node").alias("most")).where("most <> leader").select("sig", "leader"), "shared")
    buckets = written(members.join(shared, "sig").select("sig", "node", "leader").distinct(), "buckets")

    # Everything after this concerns only the sets that share a bucket with another.
    involved = written(buckets.select("node").distinct(), "involved")
    sketches = written(filled.select("node", "n_shingles", "odd").join(involved, "node", "left_semi").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("odd").alias("odd")), "sketches")
    forget(docs.sparkSession, large)
    stars = buckets.where("node <> leader").groupBy(F.col("node").alias("a"), F.col("leader").alias("b")).agg(F.count("*").alias("shared"))
    stars = written(_plausible(stars, sketches, percent), "stars")
    labels = written(sketches.select("node", F.col("node").alias("component")), "labels")

    holders = marked.where(usable).join(involved, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    sets = rows.join(holders.select("doc_id"), "doc_id", "left_semi").mapInArrow(_sets(words), "node long, check long, shingles binary")
    sets = written(_renamed(sets, clashing).drop("check").join(involved, "node", "left_semi").dropDuplicates(["node"]), "sets")

    best = stars.groupBy("a").agg(F.max(F.struct("shared", "b")).alias("top")).select("a", F.col("top.b").alias("b"))
    labels = components(_verified(best, sets, percent), labels)
    rest = _apart(stars.select("a", "b").join(best, ["a", "b"], "left_anti"), labels)
    labels = components(_verified(rest, sets, percent), labels)

    for turn in range(ROUNDS):
        placed = written(_open(buckets.select("sig", "node"), labels), "open")
        drawn = placed.groupBy("sig").agg(F.min(F.struct(F.xxhash64("node", "sig", F.lit(turn)), "node", "component")).alias("d")).select("sig", F.col("d.node").alias("leader"), F.col("d.component").alias("of"))
        pairs = placed.join(written(drawn, "leaders"), "sig").where("component <> of").select(*_ordered("node", "leader")).groupBy("a", "b").agg(F.count("*").alias("shared"))
        labels = components(_verified(written(_plausible(pairs, sketches, percent).select("a", "b"), "drawn"), sets, percent), labels)

    placed = written(_open(buckets.select("sig", "node"), labels), "open")
    labels = components(_verified(written(_crossing(placed, sketches, percent), "crossing"), sets, percent), labels)
    return marked, labels


def dedup(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that of the smallest identifier (ties by the text's hash): all columns. Rows of a null identifier or an empty set stay."""
    marked, least = _linked(docs, words, percent, id_col, text_col, keyed=True)
    placed = marked.where("n_shingles > 0 and doc_id is not null").select("doc_id", "row", "node").join(least.select("node", "component"), "node")
    best = written(placed.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("n")).where("n > 1").select("component", "best"), "best")
    return kept_rows(docs, placed.join(best, "component").select("doc_id", "row", (F.struct("doc_id", "row") == F.col("best")).alias("kept")), id_col, text_col)
