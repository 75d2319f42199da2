"""What operators hold in a worker's memory, and what they give back."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from tidewater.functions.tables import listed
from tidewater.llm import library_ids, toxicity
from tidewater.llm.common import lean


class Captured:
    """Stands in for a table: keeps the function that its rows would go through."""

    sparkSession = SimpleNamespace(conf=SimpleNamespace(get=lambda _: "4"))

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    def repartition(self, *_):
        return self

    sortWithinPartitions = repartition


def test_pairs_are_gathered_in_one_array(monkeypatch):
    """Keys that meet in a task take their own eight bytes and little more, and go out in small batches; the counts are those of all keys."""
    n, v = 1 << 18, 3000
    monkeypatch.setattr(toxicity, "GATHERED", n)
    keys = np.random.default_rng(1).integers(0, v * v, 1000)[np.random.default_rng(2).integers(0, 1000, 5 * n // 2)]
    table = Captured()
    toxicity._met(table, lambda batch: (keys[a : a + 700].copy() for a in range(0, len(keys), 700)), v, v)
    list(table.run(iter([None])))  # what is imported on first use doesn't count
    rows = []
    tracemalloc.start()
    try:
        for batch in table.run(iter([None])):
            assert len(batch) <= 256
            rows += batch.to_pylist()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 16 * n
    rows.sort(key=lambda x: x["bucket"])
    got = [(k, c) for ks, cs in toxicity._merged(iter([pa.RecordBatch.from_pylist(rows)])) for k, c in zip(ks.tolist(), cs.tolist())]
    key, count = np.unique(keys, return_counts=True)
    assert got == list(zip(key.tolist(), count.tolist()))


def test_a_worker_gives_back_what_it_has_freed():
    """Neither what it remembers of another operator nor freed memory between blocks in use stays."""

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 / 1e6

    pins = []

    def run(batches):
        held = [np.ones(12_000) for _ in range(3000)]  # 288 MB in blocks that aren't mapped one by one
        pins.append(held[-1])
        assert resident() > before + 200
        yield from batches

    library_ids._made["no file", True] = None
    before = resident()
    assert list(lean(run)(iter([1, 2]))) == [1, 2]
    assert not library_ids._made and resident() < before + 60


def test_listed_rows(spark):
    rows = [(1, None, True, "é"), (-(2**63), 2, False, None)]
    got = listed(spark, iter(rows), "a long, b int, c boolean, d string")
    assert got.dtypes == [("a", "bigint"), ("b", "int"), ("c", "boolean"), ("d", "string")] and [tuple(r) for r in got.collect()] == rows
    assert listed(spark, [], "a long, b int").collect() == []
