"""Framed sample blocks: a decoder that finds its way back after damage, a batch and a stream reader over files of them, and their accounts.

A block is a 4-byte magic, a 32-bit sequence number, a 16-bit sample count, 16-bit flags, and the
samples as 16-bit integers, all little-endian.
"""

from __future__ import annotations

import itertools
import struct
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.shipping import ship

# The data source travels by value: the process that plans its reads has no shipped packages.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed values of the wire format.
MAGIC, OVERRUN, FIRST, LAST = b"SIH1", 1, 2, 4
_HEAD = "<4sIHH"
_SIZE = struct.calcsize(_HEAD)
#: Blocks that leave a task together.
BLOCKS = 256
SCHEMA = "seq long, flags int, overrun boolean, first boolean, last boolean, samples array<short>, skipped long"
_NAMES = ["path", "place", *(f.split()[0] for f in SCHEMA.split(", "))]
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(pa.int16()), pa.int64()]


def decode(raw: bytes, most: int = 4096) -> Iterator[tuple]:
    """(seq, flags, overrun, first, last, samples, bytes skipped before it) of each whole block; stops after LAST."""
    at = skipped = 0
    while True:
        found = raw.find(MAGIC, at)
        if found < 0 or found + _SIZE > len(raw):
            return
        skipped += found - at
        _, seq, n, flags = struct.unpack_from(_HEAD, raw, found)
        end = found + _SIZE + 2 * n
        if n > most or end > len(raw):
            at, skipped = found + 1, skipped + 1
            continue
        yield seq, flags, bool(flags & OVERRUN), bool(flags & FIRST), bool(flags & LAST), list(struct.unpack_from(f"<{n}h", raw, found + _SIZE)), skipped
        at, skipped = end, 0
        if flags & LAST:
            return


def encode(seq: int, samples: list[int], flags: int = 0) -> bytes:
    return struct.pack(_HEAD, MAGIC, seq, len(samples), flags) + struct.pack(f"<{len(samples)}h", *samples)


def write_captures(df: DataFrame, path: str, capture: str, sequence: str, samples: str) -> None:
    """Writes rows as blocks, each capture a folder of parts in order of the sequence. A part appears whole, and a task that runs again writes the same one."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(capture).cast("string").alias("capture"), F.col(sequence).cast("long").alias("seq"), F.col(samples).cast("array<short>").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, now, out = TaskContext.get().partitionId(), None, None
        files, place = _file_system(path)

        def finish() -> None:
            out.close()
            files.move(f"{place}/{now}/.part-{part:08d}", f"{place}/{now}/part-{part:08d}.bin")

        for batch in batches:
            for name, seq, x in zip(*(batch.column(c).to_pylist() for c in ("capture", "seq", "x"))):
                if name != now:
                    if out is not None:
                        finish()
                    files.create_dir(f"{place}/{name}")
                    now, out = name, files.open_output_stream(f"{place}/{name}/.part-{part:08d}")
                out.write(encode(seq, x or []))
        if out is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], ["part"])

    rows.where("capture is not null").repartitionByRange(n, "capture", "seq").sortWithinPartitions("capture", "seq").mapInArrow(run, "part int").write.format("noop").mode("overwrite").save()


def decoded(files: DataFrame) -> DataFrame:
    """path, place (of the block in its file) and the columns of SCHEMA, of files as Spark's binary source reads them, wherever they lie."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = decode(content.as_buffer().to_pybytes())
                at = 0
                while some := list(itertools.islice(rows, BLOCKS)):
                    place = [(path, at + k, *row) for k, row in enumerate(some)]
                    at += len(some)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*place), _KINDS)], _NAMES)

    return files.select("path", "content").mapInArrow(run, f"path string, place long, {SCHEMA}")


def scan(spark: SparkSession, path: str) -> DataFrame:
    return decoded(spark.read.format("binaryFile").load(path))


def stream(spark: SparkSession, path: str, files_a_batch: int = 64) -> DataFrame:
    """The blocks of files as they arrive."""
    return decoded(spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_a_batch).load(path))


def accounts(blocks: DataFrame, key: str = "path") -> DataFrame:
    """By stream: blocks, samples, sequence gaps, blocks lost in them, overruns, bytes skipped, times of finding back, and whether it ended."""
    expected = F.lag("seq").over(Window.partitionBy(key).orderBy("place")) + 1
    lost = F.greatest(F.col("seq") - expected, F.lit(0))
    return blocks.withColumn("_lost", F.coalesce(lost, F.lit(0))).groupBy(key).agg(
        F.count("*").alias("blocks"), F.sum(F.size("samples")).alias("samples"), F.count_if(F.col("_lost") > 0).alias("gaps"), F.sum("_lost").alias("lost"),
        F.count_if("overrun").alias("overruns"), F.sum("skipped").alias("skipped"), F.count_if(F.col("skipped") > 0).alias("resyncs"), F.bool_or("last").alias("ended"),
    )


# --- captures as a data source ---------------------------------------------------------------------

#: Bytes that are searched for a block's beginning at once.
WINDOW = 1 << 16


@dataclass(frozen=True)
class Capture(InputPartition):
    """A range of whole blocks of a capture: the bytes of its parts one after another, wherever they are cut."""

    path: str
    parts: tuple[tuple[str, int], ...]  # place and size, in order
    begin: int = 0
    end: int = 0
    place: int = 0  # number of the first block

    def size(self) -> int:
        return sum(n for _, n in self.parts)

    def read(self, begin: int, end: int) -> bytes:
        out, at = [], 0
        for path, n in self.parts:
            a, b = max(begin - at, 0), min(end - at, n)
            if a < b:
                files, place = _file_system(path)
                with files.open_input_file(place) as f:
                    out.append(f.read_at(b - a, a))
            at += n
        return b"".join(out)


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def captures(path: str) -> list[Capture]:
    """The captures in a folder: each file there, and each folder of parts, which are one capture in order of their names."""
    from pyarrow import fs

    files, place = _file_system(path)
    of: dict[str, list[tuple[str, int]]] = {}
    prefix = path[: len(path) - len(place)] if ":" in path else ""
    for info in sorted(files.get_file_info(fs.FileSelector(place, recursive=True)), key=lambda i: i.path):
        inner = info.path[len(place.rstrip("/")) + 1 :]
        if info.type == fs.FileType.File and not inner.split("/")[-1].startswith((".", "_")):
            of.setdefault(inner.split("/")[0], []).append((prefix + info.path, info.size))
    return [Capture(k, tuple(parts)) for k, parts in of.items()]


def boundaries(read: Callable[[int, int], bytes], size: int, at: int, most: int, closed: bool) -> Iterator[tuple[int, bool]]:
    """(end, whether it is the last) of each whole block from ``at`` on, by its headers only. A block that isn't all there is waited for, unless the capture is ``closed``: then ``decode``'s rule holds."""
    while True:
        found = at if read(at, min(at + 4, size)) == MAGIC else -1
        while found < 0 and at + _SIZE <= size:
            hit = read(at, min(at + WINDOW, size)).find(MAGIC)
            found, at = (at + hit, at) if hit >= 0 else (-1, at + WINDOW - len(MAGIC) + 1)
        if found < 0 or found + _SIZE > size:
            return
        _, _, n, flags = struct.unpack(_HEAD, read(found, found + _SIZE))
        end = found + _SIZE + 2 * n
        if n > most or (closed and end > size):
            at = found + 1
            continue
        if end > size:
            return
        yield end, bool(flags & LAST)
        if flags & LAST:
            return
        at = end


class _Reads:
    """Where captures may be cut: by capture the furthest block's end, the number of blocks up to it, and whether the last came."""

    def __init__(self, options: dict[str, str]):
        self.path, self.most = options["path"], int(options.get("most", 4096))
        self.bytes, self.closed = int(options.get("bytes_a_partition", 32 << 20)), options.get("closed", "false") == "true"
        self.cuts: dict[str, list[tuple[int, int]]] = {}
        self.at: dict[str, list] = {}

    def furthest(self) -> dict[str, list]:
        for c in captures(self.path):
            at, n, done = self.at.get(c.path, [0, 0, False])
            cuts = self.cuts.setdefault(c.path, [(0, 0)])
            for end, last in () if done else boundaries(c.read, c.size(), at, self.most, self.closed):
                at, n, done = end, n + 1, last
                if end - cuts[-1][0] >= self.bytes:
                    cuts.append((end, n))
            self.at[c.path] = [at, n, done]
        return dict(self.at)

    def ranges(self, start: dict[str, list], end: dict[str, list]) -> list[Capture]:
        out = []
        for c in captures(self.path):
            (a, n, _), (b, _, _) = start.get(c.path, [0, 0, False]), end.get(c.path, [0, 0, False])
            inner = [x for x in self.cuts.get(c.path, ()) if a < x[0] < b]
            for (x, k), (y, _) in itertools.pairwise([(a, n), *inner, (b, 0)]):
                if x < y:
                    out.append(Capture(c.path, c.parts, x, y, k))
        return out

    def rows(self, c: Capture) -> Iterator[pa.RecordBatch]:
        rows, at = decode(c.read(c.begin, c.end), self.most), c.place
        while some := list(itertools.islice(rows, BLOCKS)):
            place = [(c.path, at + k, *row) for k, row in enumerate(some)]
            at += len(some)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*place), _KINDS)], _NAMES)


class _BatchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.reads = _Reads({**options, "closed": "true"})

    def partitions(self) -> Sequence[InputPartition]:
        return self.reads.ranges({}, self.reads.furthest())

    def read(self, partition: Capture) -> Iterator[pa.RecordBatch]:
        return self.reads.rows(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.reads = _Reads(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.reads.furthest()

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self.reads.ranges(start, end)

    def read(self, partition: Capture) -> Iterator[pa.RecordBatch]:
        return self.reads.rows(partition)


class BlockSource(DataSource):
    """Framed blocks of captures that grow, by file or in parts: ``spark.read`` and ``spark.readStream`` with ``format("framed_blocks")``.

    Options: ``path``; ``bytes_a_partition``; ``most`` (samples a block may have); ``closed`` (for streams: no capture grows any more,
    so what isn't a whole block at its end is damage). An offset is the end of the last whole block, so a block that two reads share waits for
    the rest; the driver reads headers only, and ranges of whole blocks are decoded by tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "framed_blocks"

    def schema(self) -> str:
        return f"path string, place long, {SCHEMA}"

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BlockSource)
