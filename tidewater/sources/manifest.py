"""The clip manifest and the take ledger: typed scans, partitioned and published sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.splits import numbered

#: The manifest's 29 columns in their order, with the type each is cast to.
MANIFEST = (
    "clip_id string, filepath string, class string, sub_label string, model_target string, source_type string, speaker_id string, voice_id string, "
    "synthetic boolean, microphone string, source_corpus string, source_license string, text string, sample_rate int, duration_samples int, "
    "keyword_onset_ms double, keyword_offset_ms double, keyword_coverage double, speaking_rate string, length_scale double, augmentation string, "
    "snr_db double, gain_db double, rms_dbfs double, measured_snr_db double, session_id string, split string, generation_seed long, sha256 string"
)
#: The ledger's 20 columns.
LEDGER = (
    "clip string, utc timestamp, content string, label string, accepted boolean, reason string, span_ms double, band_peak_db double, snr_db double, env_sd_db double, "
    "env_p95_db double, mod_2_8hz_db double, truncated boolean, samples long, lost_blocks long, distance_m string, volume string, pace string, environment string, notes string"
)


def _fields(schema: str) -> list[tuple[str, str]]:
    return [tuple(f.split(" ", 1)) for f in schema.split(", ")]


def typed(raw: DataFrame, schema: str = MANIFEST) -> DataFrame:
    """All-text columns cast once: an empty text is null, ``nan`` stays NaN, a number that can't be read is null, missing columns are null.

    A negative onset means that none was found: it becomes null, and ``onset_missing`` says so.
    """
    out = []
    for name, kind in _fields(schema):
        if name not in raw.columns:
            out.append(F.lit(None).cast(kind).alias(name))
            continue
        value = F.when(F.trim(name) != "", F.trim(name))
        out.append((value if kind == "string" else value.try_cast(kind)).alias(name))
    df = raw.select(*out)
    if "keyword_onset_ms" in df.columns:
        df = df.withColumn("onset_missing", F.coalesce(F.col("keyword_onset_ms") < 0, F.lit(False))).withColumn("keyword_onset_ms", F.when(~F.col("onset_missing"), F.col("keyword_onset_ms")))
    return df


def read_csv(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """A CSV of one split or several files of them (gzip or plain); every column is read as text and cast."""
    return typed(spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path), schema)


def write_parquet(df: DataFrame, path: str) -> None:
    """The manifest by split and class, so that a reader of one split reads only its folders."""
    df.write.mode("overwrite").partitionBy("split", "class").parquet(path)


def publish_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """Records as JSON, one a line; null fields are left out."""
    df.write.mode("overwrite").json(path)


def _is_there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def append_ledger(df: DataFrame, path: str, schema: str = LEDGER) -> None:
    """Adds takes to a ledger of CSV files. Its header is written once, by the first call, as a file of its own under ``header``; rows go under ``rows``, in the ledger's columns, null as empty."""
    spark, fields = df.sparkSession, _fields(schema)
    if not _is_there(spark, f"{path}/header"):
        spark.createDataFrame([(",".join(n for n, _ in fields),)], "line string").coalesce(1).write.text(f"{path}/header")
    rows = df.select(*((F.col(n) if n in df.columns else F.lit(None)).cast(k).alias(n) for n, k in fields))
    rows.write.mode("append").option("emptyValue", "").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss'Z'").csv(f"{path}/rows")


def read_ledger(spark: SparkSession, path: str, schema: str = LEDGER) -> DataFrame:
    """The typed rows of a ledger."""
    names = [n for n, _ in _fields(schema)]
    return typed(spark.read.csv(f"{path}/rows", schema=", ".join(f"{n} string" for n in names)), schema)


def content_key(df: DataFrame, columns: list[str], pipeline: str, order: list[str] | None = None) -> str:
    """A name for what is derived from these rows by a pipeline: the same rows have the same name, in any order, or with ``order`` only in that one (each row then counts with its number)."""
    import hashlib

    if order:
        df, columns = numbered(df, order, "_number"), [*columns, "_number"]
    row = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns))
    got = df.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("s"), F.bit_xor(row).alias("x")).first()
    return hashlib.sha256(f"{pipeline}|{columns}|{got['n']}|{got['s']}|{got['x']}".encode()).hexdigest()


def cached(df: DataFrame, path: str) -> DataFrame:
    """What lies at ``path``, written first if nothing does."""
    spark = df.sparkSession
    if not _is_there(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
