"""Token ids written to, and read from, grammar-compressed files (format: ``repair``).

Documents are dealt to parts by ascending ranges of doc_id and sorted in each, so the files hold
all ids in ascending doc_id order. Only one sum per part goes to the driver.

Defined cases: a null text is empty and holds just the end id; rows without an identifier come first; rows of equal doc_id lie next to
each other, by text; an empty table writes no shard and reads back empty; other columns are not
read. A text of any length lies whole in one shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe
from .common import partitions, shared_path, for_workers, two_columns
from .library_ids import LibraryIds, library_ids
from .repair import Grammar, compress, packed

#: A shard closes once it holds so many ids.
SHARD_IDS = 1 << 20
#: Stands for a null identifier in the files.
NULL_ID = -(1 << 63)
FORMAT = "part int, shard int, start long, n_ids long, first_id long, last_id long, doc_ids binary, ends binary, lengths binary, alphabet binary, rules binary, expansion binary, sequence binary, width int"


def _shard(part: int, shard: int, start: int, doc_ids: list[int], lengths: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    g = compress(ids, np.cumsum(lengths))
    sequence, width = packed(g["sequence"])
    values = [part, shard, start, len(ids), doc_ids[0], doc_ids[-1], np.array(doc_ids, "<i8").tobytes(), g["ends"].astype("<i8").tobytes(), lengths.astype("<i8").tobytes(), g["alphabet"].astype("<u4").tobytes(), g["rules"].astype("<u4").tobytes(), g["expansion"].astype("<u4").tobytes(), sequence, width]
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4, *[pa.binary()] * 7, pa.int32()]
    names = [x.split()[0] for x in FORMAT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)


def _runs(batches: Iterator[pa.RecordBatch], encode: LibraryIds, end_id: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(doc_ids, lengths, ids with end ids) of documents, cut so that none but the last of a run's documents makes ``SHARD_IDS`` ids."""
    held = 0
    for batch in batches:
        doc_ids = [NULL_ID if i is None else i for i in batch.column("doc_id").to_pylist()]
        for first, last, ids, ends in encode.batches(batch.column("text")):
            ids = np.insert(ids, ends, np.uint32(end_id))
            ends = ends + np.arange(1, last - first + 1)
            done, before = 0, 0
            while done < last - first:
                k = int(np.searchsorted(ends[done:], before + SHARD_IDS - held)) + 1 + done  # one past the document that fills the shard
                own = ends[done:k]
                yield doc_ids[first + done : first + min(k, last - first)], np.diff(own, prepend=before), ids[before : own[-1]]
                held = 0 if k <= last - first else held + int(own[-1]) - before
                done, before = k, int(own[-1])


def write_ids(docs: DataFrame, to: str, path: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text with the tokenizers library, appends ``end_id``, writes the shards as Parquet under ``to``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = library_ids(path or bytebpe.tokenizer_path("byte_bpe_50k.json"), True)
        part, shard, start, doc_ids, lengths, ids = TaskContext.get().partitionId(), 0, 0, [], [], []
        for own_ids, own_lengths, own in _runs(batches, encode, end_id):
            doc_ids += own_ids
            lengths.append(own_lengths)
            ids.append(own)
            if (held := sum(map(len, ids))) >= SHARD_IDS:
                yield _shard(part, shard, start, doc_ids, np.concatenate(lengths), np.concatenate(ids))
                shard, start, doc_ids, lengths, ids = shard + 1, start + held, [], [], []
        if doc_ids:
            yield _shard(part, shard, start, doc_ids, np.concatenate(lengths), np.concatenate(ids))

    rows = two_columns(docs, id_col, text_col)
    rows = rows.repartitionByRange(partitions(rows), "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, FORMAT).write.parquet(to)


def read_ids(spark: SparkSession, where: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary) and ids_crc32, decoded from the files."""
    return _read(spark, where, True)


def _read(spark: SparkSession, where: str, with_ids: bool) -> DataFrame:
    for_workers(spark)
    files = spark.read.schema(FORMAT).parquet(where)
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # one number per part
    before, total = {}, 0
    for r in sums:
        before[r["part"]], total = total, total + r["n"]
    base = spark.sparkContext.broadcast(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                g = Grammar(np.frombuffer(row["alphabet"], "<u4"), np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["expansion"], "<u4"))
                ids = memoryview(g.expand(np.frombuffer(row["sequence"], f"<u{row['width']}")).astype("<u4").tobytes())
                lengths = np.frombuffer(row["lengths"], "<i8")
                ends = np.cumsum(lengths)
                own = [ids[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist())]
                doc_ids = np.frombuffer(row["doc_ids"], "<i8")
                out = [pa.array(doc_ids, mask=doc_ids == NULL_ID), pa.array(ends - lengths + (base.value[row["part"]] + row["start"])), pa.array(lengths), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    out, names = [*out, pa.array([bytes(x) for x in own], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names)

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def read_document(spark: SparkSession, where: str, doc_id: int) -> list[list[int]]:
    """Random access: the ids of the rows with one doc_id, of which only their own slice is decoded."""
    out = []
    shards = spark.read.schema(FORMAT).parquet(where).where(F.lit(doc_id).between(F.col("first_id"), F.col("last_id")))
    for row in shards.orderBy("part", "shard").toLocalIterator():
        ids, ends = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["ends"], "<i8")
        g = None
        for k in np.flatnonzero(ids == doc_id).tolist():
            g = g or Grammar(np.frombuffer(row["alphabet"], "<u4"), np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["expansion"], "<u4"))
            seq = np.frombuffer(row["sequence"], f"<u{row['width']}")
            out.append(g.expand(seq[ends[k - 1] if k else 0 : ends[k]]).tolist())
    return out


def id_digests(docs: DataFrame, path: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files, reads them back: doc_id, start, n_tokens, ids_crc32 (unsigned)."""
    spark = docs.sparkSession
    to = shared_path(spark, "ids")
    write_ids(docs, to, path, end_id, id_col, text_col)
    return _read(spark, to, False)
