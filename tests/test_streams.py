"""Stateful streams over several micro-batches: equal to one batch, and state that goes."""

import random
import time

import pytest

from tidewater.operators import sequence
from tidewater.streaming import stateful


def batches(spark, path, rows, schema, parts):
    """The rows as so many files in order, read one a micro-batch."""
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        time.sleep(0.01)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_trigger_ring_and_loss_over_batches(spark, tmp_path):
    r = random.Random(3)
    rows = [(k % 3, float(k // 3), k, r.random() < 0.6) for k in range(150)]
    stream = batches(spark, tmp_path, rows, "s long, t double, k long, hit boolean", 3)
    fired = stateful.replay(stateful.trigger(stream, "s", "t", "k", "hit", 7.0), spark, f"{tmp_path}/c1", "fired_out").collect()
    want = []
    for s in range(3):
        own, last = [x for x in rows if x[0] == s], None
        for i, (_, t, k, _) in enumerate(own):
            if sum(h for *_, h in own[max(0, i - 2) : i + 1]) >= 2 and (last is None or t - last >= 7):
                last = t
                want.append((s, t, k))
    assert sorted(map(tuple, fired)) == sorted(want)
    ring = stateful.framer(stream.selectExpr("s", "k", "array(t, t + 0.5) as x"), "s", "k", "x", 3, 2, ring=4, every=5)
    got = {(x["stream"], x["frame"]): list(x["samples"]) for x in stateful.replay(ring, spark, f"{tmp_path}/c2", "ring_every_out").collect()}
    samples = [v for t in range(50) for v in (t, t + 0.5)]
    frames = [samples[a : a + 3] for a in range(0, len(samples) - 2, 2)]
    assert got == {(s, k): sum(frames[k - 3 : k + 1], []) for s in range(3) for k in range(4, len(frames), 5)}
    loss = stateful.replay(stateful.loss(stream.where("k % 7 > 0"), "s", "k", "k"), spark, f"{tmp_path}/c3", "loss_out", "update").collect()
    last = {}
    for x in loss:
        last[x["stream"]] = max(last.get(x["stream"], (0, 0, 0)), (x["seen"], x["gaps"], x["lost"]))
    for s in range(3):
        ks = [k for k in range(s, 150, 3) if k % 7]
        gaps = [k - e for k, e in zip(ks, [0, *(k + 1 for k in ks)]) if k > e]
        assert last[s] == (len(ks), len(gaps), sum(gaps))


def test_utterances_over_batches(spark, tmp_path):
    r = random.Random(5)
    t, rows = 0.0, []
    for _ in range(120):
        t += r.choice([0.1, 0.3, 0.5, 0.79, 0.81, 2.0])
        rows.append((r.choice([1, 1, 2]), round(t, 3)))
    stream = batches(spark, tmp_path, [*rows, (None, 1e6)], "s long, t double", 4)
    out = stateful.utterances(stream, "s", "t", cap=3.0, late="5 seconds")
    got = stateful.replay(out, spark, f"{tmp_path}/c", "utterances_out").collect()
    want = sequence.utterances(spark.createDataFrame(rows, "s long, t double"), "s", "t", cap=3.0).collect()
    assert len(want) > 20
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


@pytest.mark.parametrize("idle, fires", [(None, 1), (1.0, 2)])
def test_the_state_of_an_idle_stream_goes(spark, tmp_path, idle, fires):
    """Three hits of one stream, a pause, three more within the hold: they fire only where the state has gone."""
    schema = "s long, t double, k long, hit boolean"
    name = f"idle_out_{fires}"

    def add(first):
        spark.createDataFrame([(1, float(first + k), first + k, True) for k in range(3)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def wait(n):
        until = time.time() + 60
        while spark.table(name).count() < n and time.time() < until:
            time.sleep(0.3)

    add(0)
    out = stateful.trigger(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "s", "t", "k", "hit", 1000.0, idle=idle)
    query = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        wait(1)
        time.sleep(3)
        add(10)
        if idle is None:
            query.processAllAvailable()
        wait(fires)
        assert spark.table(name).count() == fires
    finally:
        query.stop()
