"""Labelled documents, all or a bounded sample, and the folds that hold labels out."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of five folds, rows of this one are never learned from.
FOLDS, HELD_OUT = 5, 0


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the identifier as text leaves remainder 0; a null identifier isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def labelled_ids(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and y (0 or 1) of all labels outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    return known.where(~held_out(F.col("doc_id"))).distinct()


@dataclass
class Sieve:
    """Passes all keys of a set, and few others."""

    bits: np.ndarray

    def holds(self, keys: pa.Array) -> np.ndarray:
        at = keys.to_numpy().view(np.uint64) & np.uint64(64 * len(self.bits) - 1)
        return (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


#: Bits of a sieve for each key (one other key in 16 passes, or fewer), and at most (16 MB; beyond 8 million keys more others pass).
BITS, MOST_BITS = 16, 1 << 27


def sieve(keys: DataFrame) -> Broadcast:
    """The Sieve of a column of hashes named ``key``, in all workers. What passes is still to be joined."""
    size = min(MOST_BITS, 1 << max(12, (BITS * keys.count()).bit_length()))
    place = F.col("key").bitwiseAND(F.lit(size - 1))
    rows = keys.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(Sieve(bits))


def sample(docs: DataFrame, labels: DataFrame, label: str, each: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], list[int], dict[int, int]]:
    """Texts and labels of at most ``each`` rows of either class, least hash of the identifier first, and how many rows each class has. Null labels and the held-out fold take no part."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").where(~held_out(F.col("_id")))
    counts = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    order = [F.xxhash64("_id"), F.col("_id")]
    chosen = known.where("_y = 0").orderBy(*order).limit(each).unionByName(known.where("_y = 1").orderBy(*order).limit(each))
    rows = docs.select(F.col(id_col).cast("long").alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    rows = rows.groupBy("_doc", "_y").agg(F.min("_text").alias("_text")).collect()  # 2 * each rows, however often an identifier is repeated
    rows.sort(key=lambda r: (hash_order(r["_doc"]), r["_doc"], r["_text"]))
    return [r["_text"] for r in rows], [r["_y"] for r in rows], counts


def hash_order(doc_id: int) -> int:
    return doc_id * 0x9E3779B97F4A7C15 % (1 << 64)
