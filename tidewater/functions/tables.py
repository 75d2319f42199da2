"""Tables written once in the folder that all executors share: where lineage ends and random choices are settled."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_collected: ContextVar[tuple[list[str], ...]] = ContextVar("collected", default=())


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path under spark.checkpoint.dir. Where that is unset, under a temporary folder in local mode, which has one machine; elsewhere that is an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = _local_folder()
    path = f"{top.rstrip('/')}/tidewater/{what}-{uuid.uuid4().hex}"
    for made in _collected.get():
        made.append(path)
    return path


def _local_folder() -> str:
    global _folder
    _folder = _folder or "file://" + tempfile.mkdtemp(prefix="tidewater-")
    return _folder


_folder = ""


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet and read from there."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def listed(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A few rows of the driver's as a table; unlike lists, Arrow tables start no further Python workers on the executors."""
    kinds = StructType.fromDDL(schema)
    fields = to_arrow_schema(kinds)
    columns = list(zip(*rows)) or [()] * len(fields)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields), kinds)


@contextlib.contextmanager
def collecting() -> Iterator[list[str]]:
    """The paths of all tables that are written within."""
    made: list[str] = []
    token = _collected.set((*_collected.get(), made))
    try:
        yield made
    finally:
        _collected.reset(token)


def forget(spark: SparkSession, paths: Iterable[str], but: Iterable[DataFrame] = ()) -> None:
    """Deletes written tables that no result needs any more; those that ``but`` reads stay."""
    needed = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for df in but for f in df.inputFiles()}
    for path in paths:
        if path.rsplit("/", 1)[-1] not in needed:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
