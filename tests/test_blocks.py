"""Captures of framed blocks as a data source: equal to the decoder over the whole capture, however it is cut and read."""

import random

from tidewater.sources import blocks
from tidewater.streaming import stateful


def capture(r, n, last=True):
    """Blocks with damage between them, headers that lie, and magic bytes among the samples."""
    out = [b"junk"]
    for k in range(n):
        samples = [r.randint(-32768, 32767) for _ in range(r.randint(0, 40))]
        if k % 5 == 0:
            samples += [int.from_bytes(blocks.MAGIC[i : i + 2], "little", signed=True) for i in (0, 2)]
        raw = blocks.encode(k, samples, blocks.LAST if last and k == n - 1 else k % 2)
        if r.random() < 0.2:
            raw = raw[: r.randint(0, len(raw))]  # cut off
        if r.random() < 0.2:
            raw += bytes(r.randrange(256) for _ in range(r.randint(1, 30)))
        if r.random() < 0.1:
            raw = blocks.MAGIC + (99).to_bytes(4, "little") + (60000).to_bytes(2, "little") + b"\0\0" + raw
        out.append(raw)
    return b"".join(out)


def write(folder, raw, cuts):
    folder.mkdir(parents=True)
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(raw)])):
        (folder / f"part-{k:04d}.bin").write_bytes(raw[a:b])


def test_batch_equals_the_decoder(spark, tmp_path):
    blocks.register(spark)
    r = random.Random(1)
    want = {}
    for k in range(12):
        raw = capture(r, 60, last=k % 2 > 0)
        write(tmp_path / "in" / f"c{k}", raw, sorted(r.randrange(len(raw)) for _ in range(r.randint(0, 9))))
        want[f"c{k}"] = list(blocks.decode(raw))
    (tmp_path / "in" / "single.bin").write_bytes(raw)
    want["single.bin"] = want["c11"]
    for size in ("200", "33554432"):
        got = {}
        df = spark.read.format("framed_blocks").option("path", str(tmp_path / "in")).option("bytes_a_partition", size).load()
        for x in df.orderBy("path", "place").collect():
            assert x["place"] == len(got.setdefault(x["path"], []))
            got[x["path"]].append((x.seq, x.flags, x.overrun, x.first, x.last, list(x.samples), x.skipped))
        assert got == want
        assert df.rdd.getNumPartitions() == 13 if size != "200" else df.rdd.getNumPartitions() > 30


def test_a_block_cut_between_two_reads_is_found(spark, tmp_path):
    """Parts arrive one by one, and each arrival is a micro-batch; a part may end within a header or within samples."""
    blocks.register(spark)
    r = random.Random(2)
    raw = b"".join(blocks.encode(k, [k, -k, 7 * k], blocks.LAST if k == 29 else 0) + (b"xx" if k % 6 == 0 else b"") for k in range(30))
    cuts = sorted(r.sample(range(1, len(raw)), 3))
    (tmp_path / "in" / "c").mkdir(parents=True)
    stream = spark.readStream.format("framed_blocks").option("path", str(tmp_path / "in")).load()
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(raw)])):
        (tmp_path / "in" / "c" / f"part-{k}.bin").write_bytes(raw[a:b])
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("place").collect()
    assert [x["place"] for x in got] == list(range(30))
    assert [(x.seq, x.flags, x.overrun, x.first, x.last, list(x.samples), x.skipped) for x in got] == list(blocks.decode(raw))


def test_boundaries_wait_for_what_grows():
    raw = blocks.encode(1, [1, 2, 3]) + blocks.encode(2, [4])
    for size in range(len(raw) + 1):
        found = list(blocks.boundaries(lambda a, b: raw[a:b], size, 0, 4096, closed=False))
        assert [e for e, _ in found] == [e for e in (18, 32) if e <= size]
