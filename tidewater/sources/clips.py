"""Clips as files: recursive scans, WAV headers and samples, WAV bytes, sidecars by stem."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship


def scan(spark: SparkSession, path: str, glob: str = "*.wav") -> DataFrame:
    """path, stem, content of every file below ``path`` that fits the glob."""
    ship(spark)
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return df.select("path", F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("stem"), "content")


def read_wav(raw: bytes, channels: str = "mean") -> tuple[int, np.ndarray] | None:
    """Rate and samples of 16-bit PCM, None if it isn't such a file. ``channels``: mean or first give [-1, 1); whole gives
    the channels' mean cut to whole 16-bit numbers; raw gives all 16-bit numbers as they lie, channels by turns."""
    if raw is None or len(raw) < 12 or raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        return None
    at, form, data = 12, None, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", raw, at + 8) if size >= 16 else None
        elif name == b"data":
            data = raw[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if form is None or data is None or form[0] != 1 or form[5] != 16 or not form[1]:
        return None
    n = form[1]
    whole = np.frombuffer(data[: len(data) // (2 * n) * 2 * n], "<i2").reshape(-1, n)
    if channels in ("raw", "whole"):
        return form[2], (whole.ravel() if channels == "raw" else np.trunc(whole.mean(axis=1))).astype(float)
    x = whole / 32768
    return form[2], x[:, 0] if channels == "first" else x.mean(axis=1)


def write_wav(x: np.ndarray, rate: int = 16_000) -> bytes:
    """16-bit PCM of one channel: clipped to [-1, 1], times 32767, cut to whole numbers."""
    data = (np.clip(x, -1, 1) * 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def decoded(df: DataFrame, content: str = "content", channels: str = "mean") -> DataFrame:
    """Adds rate and samples; both null where the file can't be decoded, so that drops can be counted."""
    ship(df.sparkSession)

    @F.pandas_udf("rate int, samples array<double>")
    def run(raw: pd.Series) -> pd.DataFrame:
        got = [read_wav(x, channels) for x in raw]
        return pd.DataFrame({"rate": pd.array([g and g[0] for g in got], "Int32"), "samples": [None if g is None else g[1].tolist() for g in got]})

    return df.withColumn("_wav", run(F.col(content))).withColumns({"rate": F.col("_wav.rate"), "samples": F.col("_wav.samples")}).drop("_wav")


def encoded(samples: Column) -> Column:
    """WAV bytes of arrays of samples; null stays null."""

    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else write_wav(np.asarray(v, float)))

    return run(samples)


def write_files(df: DataFrame, to: str, name: str = "path", samples: str = "samples") -> DataFrame:
    """Writes each clip as a WAV file below ``to`` (a folder that all executors share, by any URI Arrow's file systems know): name and size of each, once the result is asked for. A repeated task writes the same files again."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = fs.FileSystem.from_uri(to)
        for batch in batches:
            sizes = []
            for own, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = write_wav(np.asarray(x.as_py(), float))
                where.create_dir(f"{top}/{own}".rsplit("/", 1)[0], recursive=True)
                with where.open_output_stream(f"{top}/{own}") as out:
                    out.write(raw)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["name", "size"])

    rows = df.where(F.col(samples).isNotNull()).select(F.col(name).alias("name"), F.col(samples).cast("array<double>").alias("x"))
    return rows.mapInArrow(run, "name string, size long")


def header_rate(content: Column) -> Column:
    """The sample rate straight from a canonical header's bytes."""
    return F.conv(F.hex(F.reverse(F.substring(content, 25, 4))), 16, 10).cast("int")


def settings(text: str, environment: dict[str, str], defaults: dict[str, str]) -> dict[str, str]:
    """KEY=VALUE lines under an environment over defaults: environment first, then the file."""
    out = dict(defaults)
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#") and "=" in line:
            k, v = line.split("=", 1)
            out[k.strip()] = v.strip().strip("\"'")
    return out | {k: environment[k] for k in out if k in environment}


def report_pairs(text: Column) -> Column:
    """A device report's ``key=value`` words as a map."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w.contains("="))
    return F.map_from_entries(F.transform(words, lambda w: F.struct(F.substring_index(w, "=", 1).alias("k"), F.substring(w, F.instr(w, "=") + 1, F.length(w)).alias("v"))))
