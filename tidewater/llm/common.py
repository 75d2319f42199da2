"""Helpers that the corpus operators share: input columns, shared folders, written tables."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.shipping import BATCH_BYTES, ship
from tidewater.functions.tables import shared_path, written

from . import library_ids

__all__ = ["BATCH_BYTES", "documents", "for_workers", "give_back", "kept_rows", "labels", "lean", "partitions", "shared_path", "two_columns", "written"]

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def two_columns(docs: DataFrame, id_col: str, text_col: str, keyed: bool = False) -> DataFrame:
    """Only ``doc_id`` (long) and ``text`` (a null text is empty), and ``row`` if ``keyed``; other columns can't clash."""
    for_workers(docs.sparkSession)
    key = [_row_key(docs[text_col]).alias("row")] if keyed else []
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *key)


def _row_key(text: Column) -> Column:
    """SHA-256 of the text as it is: together with the identifier it names a row, or rows that repeat both."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def kept_rows(docs: DataFrame, marked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` (all columns) without the rows that ``marked`` (doc_id, row, kept) doesn't keep.

    ``marked`` has as many rows of an identifier and text as ``docs``, or none: these stay. Of rows that repeat both and
    of which any is kept, the one that is least by its other columns stays (maps don't count for that).
    """
    lost = marked.groupBy("doc_id", "row").agg(F.count("*").alias("n"), F.max("kept").alias("kept")).where("n > 1 or not kept")
    lost = written(lost.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "kept"), "lost")
    # Sorted and merged at any size: what is lost grows with the rows.
    out = docs.join(lost.hint("merge"), docs[id_col].cast("long").eqNullSafe(lost["_id"]) & (_row_key(docs[text_col]) == lost["_row"]), "left_anti")
    again = written(lost.where("kept").select("_id", "_row"), "again")
    if again.isEmpty():
        return out
    order = [docs[c] for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rows = docs.select(docs[id_col].cast("long").alias("_doc"), _row_key(docs[text_col]).alias("_key"), F.struct("*").alias("_all"), F.struct(*order).alias("_order"))
    rows = rows.join(again.hint("merge"), F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_row")), "left_semi")
    return out.unionByName(rows.groupBy("_doc", "_key").agg(F.min_by("_all", "_order").alias("_all")).select("_all.*"))


def for_workers(spark: SparkSession) -> None:
    """Python workers get this package, and batches of bounded size."""
    ship(spark)


def lean(run: Run, remembers: bool = False) -> Run:
    """``run``, for ``mapInArrow``, in a worker that gives back what it remembers of texts' ids before (unless ``run`` goes on with it), and what ``run`` has freed after: an idle worker would keep it all beside its executor."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not remembers:
            library_ids.release()
        try:
            yield from run(batches)
        finally:
            give_back()

    return held


def give_back() -> None:
    """Returns the memory that this process has freed to the system."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


@functools.cache
def _trim() -> Callable[[int], int]:
    """The C library's call that returns freed memory to the system; without one, nothing."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def partitions(df: DataFrame, least: int = 1) -> int:
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
