"""A corpus from raw documents to packed sequences: each stage works on all that the one before it kept.

Toxic documents go, exact copies go but one, near copies (five-word shingles, Jaccard similarity of
0.8 or more) go but one, personal data is redacted, and what is left is packed.

A stage's result is to be written before the next stage is called: its intermediate tables are
deleted then. Every stage takes an empty table, and gives an empty one for it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.tables import collecting, forget
from tidewater.llm.common import documents, labels, written
from tidewater.llm.exact_dedup import dedup as without_copies
from tidewater.llm.jaccard_join import dedup as without_near_copies
from tidewater.llm.packing import pack
from tidewater.llm.pii import redact
from tidewater.llm.toxicity import without_toxic

#: Intermediate tables of the stage that was called last.
_before: list[str] = []


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        forget(spark, _before, but=[docs])
        with collecting() as made:
            out = work(spark, docs, sf_dir)
        _before[:] = made
        return out

    return run


@_stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic, all columns. A null text is empty; without labels of both classes all stay; repeated rows and equal scores fare alike."""
    return without_toxic(docs, labels(spark, sf_dir))


@_stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (A-Z lower-cased), that of the smallest identifier, all columns. Null and empty texts are one group; a null identifier stays only where its group has no other; of repeated rows one stays."""
    return without_copies(docs, keep="smallest")


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, that of the smallest identifier, all columns. Documents without words or without an identifier stay; of repeated rows one stays."""
    return without_near_copies(docs, words=5, percent=80)


@_stage
def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their personal data replaced by its kind, all columns; ``n_chars`` is the new length, null for a null text."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and offset. A null or empty text is one piece with the end id; repeated rows are packed each by itself."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]

#: No SQL: the models and the packing aren't expressible.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), []
    for name, stage in STAGES[:-1]:
        with collecting() as made:
            docs = written(stage(spark, docs, sf_dir), name)
        forget(spark, before, but=[docs])
        before = made
    return STAGES[-1][1](spark, docs, sf_dir)
