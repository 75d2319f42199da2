"""Exact duplicates by a content sort.

Texts are normalised (A-Z lower-cased), and sampled splitters range-partition them by the first
``HEAD`` characters, the SHA-256 of the whole and the identifier: every key is of bounded size,
equal texts lie next to each other, and a group of any size is spread over as many partitions as
it fills. Each partition is sorted externally; a pass over it compares every text in full with
its neighbour and keeps only the identifiers of the current group. Groups that touch the edges of
two partitions are neighbours too: where SHA-256 and length agree, their texts are compared in
full. The driver holds two small records a partition for that.

Defined cases: a null text is empty, and empty texts are equal; of a group the row of the
smallest (or largest) identifier stays, of rows that repeat it just one; a null identifier stays
only where its group has no other; one identifier on several texts is a row in each group; an
empty table gives an empty one; columns other than the two named are passed on by ``dedup`` alone,
whatever their names.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.tables import listed

from .common import for_workers, lean, partitions, two_columns, written

#: Characters of the normalised text that lead the sort key.
HEAD = 64
SCHEMA = "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string"
_SORTED = "doc_id long, head string, sha binary, norm string"
_GROUPED = "doc_id long, first boolean, part int, edge int, keep_id long, group_size long, n_bytes long, text_sha256 string, norm string"


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        norm = pc.ascii_lower(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_keys(norm), norm], ["doc_id", "head", "sha", "norm"])


def _keys(norm: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The first characters and the SHA-256 of normalised texts."""
    sha = [hashlib.sha256(x.as_buffer()).digest() for x in norm.cast(pa.binary())]
    return pc.utf8_slice_codeunits(norm, 0, HEAD), pa.array(sha, pa.binary())


def _best(ids: list[int | None], largest: bool) -> int | None:
    there = [i for i in ids if i is not None]
    return (max if largest else min)(there) if there else None


def _grouping(largest: bool):
    names = [x.split()[0] for x in _GROUPED.split(", ")]
    kinds = [pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def rows(ids: list, part: int, edge: int, norm: pa.StringScalar, sha: bytes) -> list[tuple]:
        keep, n, text, n_bytes = _best(ids, largest), len(ids), sha.hex(), len(norm.as_buffer())
        return [(i, not k or ids[k - 1] != i, part, edge, keep, n, n_bytes, text, norm.as_py() if edge and not k else None) for k, i in enumerate(ids)]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, ids, last, sha, text, groups = TaskContext.get().partitionId(), [], None, b"", None, 0
        for batch in batches:
            norm, n = batch.column("norm"), len(batch)
            if not n:
                continue
            same = _repeated(norm, last)
            shas, out = batch.column("sha"), []
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                if not same[k]:
                    if ids:
                        out += rows(ids, part, int(groups == 1), text, sha)
                    ids, sha, text, groups = [], shas[k].as_py(), norm[k], groups + 1
                ids.append(doc_id)
            last = norm[n - 1].as_py()
            if out:
                yield batch_of(out)
        if ids:
            yield batch_of(rows(ids, part, 2 + (groups == 1), text, sha))

    return run


def _repeated(norm: pa.Array, last: str | None) -> list[bool]:
    """Whether each text equals the one before it, of which ``last`` comes before the first."""
    return [last is not None and norm[0].as_py() == last, *pc.equal(norm.slice(1), norm.slice(0, len(norm) - 1)).to_pylist()]


def _joined(edges: DataFrame, text: Column) -> tuple[list, set[int]]:
    """The records of the groups at edges (part, edge, sha, n_bytes and more), in order, and the parts whose first group goes on from the one before. ``edges`` has one row with a text for each; edge 1 is a partition's first group, 2 its last, 3 its only one."""
    records = sorted(edges.drop("norm").collect(), key=lambda e: (e["part"], e["edge"]))  # two a partition at most
    alike, before = [], None
    for e in records:
        if before is not None and e["edge"] != 2 and (e["sha"], e["n_bytes"]) == (before["sha"], before["n_bytes"]):
            alike.append((before["part"], before["edge"], e["part"], e["edge"]))
        if e["edge"] != 1:
            before = e
    if not alike:
        return records, set()
    pairs = listed(edges.sparkSession, alike, "_a int, _ea int, _b int, _eb int")
    texts = edges.select("part", "edge", text.alias("norm"))
    one, two = (texts.select(F.col("part").alias(p), F.col("edge").alias(e), F.col("norm").alias(t)) for p, e, t in (("_a", "_ea", "_x"), ("_b", "_eb", "_y")))
    same = pairs.join(one, ["_a", "_ea"]).join(two, ["_b", "_eb"]).where("_x = _y").select("_b")
    return records, {r["_b"] for r in same.collect()}


def _across(edges: list, joined: set[int], largest: bool) -> list[tuple]:
    """(part, edge, keep_id, group_size, owner) of the groups that go on over edges, along the order of the partitions."""
    chains: list[list] = []
    for e in edges:
        if e["part"] in joined and e["edge"] != 2:
            chains[-1].append(e)
        else:
            chains.append([e])
    return [(e["part"], e["edge"], _best([x["keep_id"] for x in chain], largest), sum(x["group_size"] for x in chain), k == (len(chain) - 1 if largest else 0)) for chain in chains if len(chain) > 1 for k, e in enumerate(chain)]


def exact_groups(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    largest = {"smallest": False, "largest": True}[keep]
    rows = two_columns(docs, id_col, text_col).mapInArrow(lean(_normalised), _SORTED)
    rows = rows.repartitionByRange(partitions(rows), "head", "sha", "doc_id").sortWithinPartitions("head", "sha", "norm", "doc_id")
    groups = written(rows.mapInArrow(lean(_grouping(largest)), _GROUPED), "groups")
    edges = groups.where("norm is not null").select("part", "edge", "keep_id", "group_size", "n_bytes", F.col("text_sha256").alias("sha"), "norm")
    joined = listed(docs.sparkSession, _across(*_joined(edges, F.col("norm")), largest), "part int, edge int, k long, n long, owner boolean")
    out = groups.join(F.broadcast(joined), ["part", "edge"], "left")
    keep_id = F.when(F.col("n").isNotNull(), F.col("k")).otherwise(F.col("keep_id"))
    kept = F.col("first") & F.when(keep_id.isNull(), F.coalesce(F.col("owner"), F.lit(True))).otherwise(F.coalesce(F.col("doc_id") == keep_id, F.lit(False)))
    return out.select("doc_id", keep_id.alias("keep_id"), F.coalesce("n", "group_size").alias("group_size"), kept.alias("kept"), "text_sha256")


def dedup(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group, the one that ``exact_groups`` keeps: all columns.

    Whole rows are sorted, so texts are shuffled once and the first row of a group is the one to keep: that of the
    smallest (largest) identifier, the least by its other columns among rows that repeat it (maps don't count for that).
    """
    spark = docs.sparkSession
    for_workers(spark)
    by_id = {"smallest": F.asc_nulls_last, "largest": F.desc_nulls_last}[keep]("doc_id")
    at = docs.columns.index(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.struct("*").alias("row"))
    whole = rows.schema["row"]
    keyed = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("head", T.StringType()), T.StructField("sha", T.BinaryType()), whole])
    rows = rows.mapInArrow(lean(_with_keys(at)), keyed)
    others = [F.col("row").getField(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rows = rows.repartitionByRange(partitions(rows), "head", "sha", by_id).sortWithinPartitions("head", "sha", by_id, *others)
    first = T.StructType([whole, *(T.StructField(c, k) for c, k in (("part", T.IntegerType()), ("edge", T.IntegerType()), ("sha", T.BinaryType()), ("n_bytes", T.LongType())))])
    firsts = written(rows.mapInArrow(lean(_first_rows(at)), first), "firsts")
    norm = F.translate(F.coalesce(F.col("row").getField(text_col), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    edges = firsts.where("edge > 0").select("part", "edge", F.hex("sha").alias("sha"), "n_bytes", norm.alias("norm"))
    _, joined = _joined(edges, F.col("norm"))
    again = listed(spark, [(p,) for p in sorted(joined)], "_part int")
    kept = firsts.join(F.broadcast(again), (F.col("part") == F.col("_part")) & F.col("edge").isin(1, 3), "left_anti")
    return kept.select("row.*")


def _with_keys(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_keys(pc.ascii_lower(pc.fill_null(row.field(at), ""))), row], ["doc_id", "head", "sha", "row"])

    return run


def _first_rows(at: int):
    """The first row of each group of sorted rows. Edge 1 marks a partition's first group, 2 its last, 3 its only one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, held, groups = TaskContext.get().partitionId(), None, None, 0

        def out(rows: pa.RecordBatch, edges: list[int]) -> pa.RecordBatch:
            there = pa.array([e > 0 for e in edges])
            sizes = pc.binary_length(pc.fill_null(rows.column("row").field(at), "")).cast(pa.int64())
            marks = [pa.array([part] * len(edges), pa.int32()), pa.array(edges, pa.int32()), pc.if_else(there, rows.column("sha"), None), pc.if_else(there, sizes, None)]
            return pa.RecordBatch.from_arrays([rows.column("row"), *marks], ["row", "part", "edge", "sha", "n_bytes"])

        for batch in batches:
            if not len(batch):
                continue
            norm = pc.ascii_lower(pc.fill_null(batch.column("row").field(at), ""))
            begins = [k for k, same in enumerate(_repeated(norm, last)) if not same]
            last = norm[len(norm) - 1].as_py()
            if not begins:
                continue
            if held is not None:
                yield out(held, [int(groups == 1)])
            if begins[1:]:
                yield out(batch.take(pa.array(begins[:-1])), [int(groups + k == 0) for k in range(len(begins) - 1)])
            held, groups = batch.take(pa.array(begins[-1:])), groups + len(begins)
        if held is not None:
            yield out(held, [2 + (groups == 1)])

    return run
