"""Sends this package to the Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes an Arrow batch holds at most, so that long texts and clips don't fill a worker.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once for each application; workers get batches of bounded size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    if not top.is_dir():  # already read from such a file
        return
    to = os.path.join(tempfile.mkdtemp(prefix="tidewater-"), "tidewater.zip")
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(to)
    _shipped.add(context.applicationId)
