"""Stateful streams: the trigger (vote and refractory hold), loss accounting, the framer with its ring, and utterances.

Each is a stateful processor over a RocksDB store: value states for the few numbers a stream needs, a
list state for the ring's frames, timers in event time for utterances. Where ``idle`` is given (seconds),
the state of a stream from which nothing came for so long goes, and what comes after begins anew; without it a
state stays. Rows that a micro-batch has of one stream are put in order first, so the batch's size (files or offsets a
trigger) bounds what a task holds of a stream.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.shipping import ship

# Processors travel by value: the process in which the driver sets up their states has no shipped packages.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _prepared(df: DataFrame) -> None:
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


def _run(rows: DataFrame, processor: StatefulProcessor, schema: str, mode: str) -> DataFrame:
    # Only what needs a clock has one: with a processing-time clock a stream has always something left to do.
    time_mode = "EventTime" if isinstance(processor, _Utterances) else "None" if processor.idle is None else "ProcessingTime"
    return rows.groupBy("stream").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode=mode, timeMode=time_mode)


def _in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    parts = list(rows)
    return (parts[0] if len(parts) == 1 else pd.concat(parts)).sort_values(by, kind="stable")


class _Kept(StatefulProcessor):
    """A processor with one value state."""

    schema = ""

    def __init__(self, idle: float | None):
        self.idle = None if idle is None else int(idle * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", self.schema, self.idle)

    def close(self) -> None:
        pass


class _Trigger(_Kept):
    schema = "seen int, trail long, last double"

    def __init__(self, hold: float, m: int, n: int, idle: float | None):
        super().__init__(idle)
        self.hold, self.m, self.n = hold, m, n

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = _in_order(rows, ["t", "k"])
        seen, trail, last = self.kept.get() or (0, 0, None)
        t, hit = got["t"].to_numpy(), got["hit"].fillna(False).to_numpy(bool)
        # The trail is the last hits as bits; a row's votes are those of the bits that a window of n holds.
        before = np.array([trail >> b & 1 for b in range(self.n - 1)][::-1], bool)
        sums = np.concatenate(([0], np.cumsum(np.concatenate((before, hit)))))
        place = np.flatnonzero(sums[self.n :] - sums[: -self.n] >= self.m) if self.n > 1 else np.flatnonzero(hit >= self.m)
        fired = []
        for i in place.tolist():
            if last is None or t[i] - last >= self.hold:
                last = float(t[i])
                fired.append(i)
        for h in hit[-self.n :].tolist():
            trail = (trail << 1 | h) & ((1 << self.n) - 1)
        self.kept.update((min(seen + len(t), 1 << 30), trail, last))
        yield pd.DataFrame({"stream": [key[0]] * len(fired), "fire": t[fired], "fired_tie": got["k"].to_numpy()[fired]})


def trigger(df: DataFrame, stream: str, time: str, tie: str, hit: str, hold: float, m: int = 2, n: int = 3, idle: float | None = None) -> DataFrame:
    """stream (long), fire (double), fired_tie (long): the firings of each stream; ``hit`` is a boolean column (null is no hit), ``n`` at most 62."""
    _prepared(df)
    rows = df.selectExpr(f"cast(`{stream}` as long) as stream", f"cast(`{time}` as double) as t", f"cast(`{tie}` as long) as k", f"cast(`{hit}` as boolean) as hit")
    return _run(rows, _Trigger(hold, m, n, idle), "stream long, fire double, fired_tie long", "append")


class _Loss(_Kept):
    schema = "expected long, seen long, gaps long, lost long"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = _in_order(rows, ["o"])
        expected, seen, gaps, lost = self.kept.get() or (0, 0, 0, 0)
        seq, last = got["seq"].to_numpy(), got["last"].to_numpy(bool)
        out = []
        for part in np.split(np.arange(len(seq)), np.flatnonzero(last) + 1):  # a flagged row ends its part
            if not len(part):
                continue
            over = seq[part] - np.concatenate(([expected], seq[part][:-1] + 1))
            gaps, lost, seen = gaps + int((over > 0).sum()), lost + int(over[over > 0].sum()), seen + len(part)
            expected, end = int(seq[part[-1]]) + 1, bool(last[part[-1]])
            out.append((key[0], seen, gaps, lost, end))
            if end:
                expected = seen = gaps = lost = 0
        if seen:
            self.kept.update((expected, seen, gaps, lost))
        else:
            self.kept.clear()
        yield pd.DataFrame(out, columns=["stream", "seen", "gaps", "lost", "ended"])


def loss(df: DataFrame, stream: str, sequence: str, order: str, last: str | None = None, idle: float | None = None) -> DataFrame:
    """stream, seen, gaps, lost, ended, after each batch: only a number above the expected one counts; one below it isn't re-sorted.

    Rows are taken by ``order``, their arrival, within a batch. A row under ``last`` (a boolean column) ends its
    stream: it is put out with ``ended``, and the state goes, so that what follows begins anew.
    """
    _prepared(df)
    end = f"coalesce(cast(`{last}` as boolean), false)" if last else "false"
    rows = df.selectExpr(f"cast(`{stream}` as long) as stream", f"cast(`{sequence}` as long) as seq", f"cast(`{order}` as long) as o", f"{end} as last")
    return _run(rows, _Loss(idle), "stream long, seen long, gaps long, lost long, ended boolean", "update")


def latencies(fires: DataFrame, spans: DataFrame, stream: str, fire: str, onset: str, offset: str, tail: float) -> DataFrame:
    """A stream of firings against a table of spans: each firing with every span of its stream that it falls in (onset to offset + ``tail``), and its latency after the span's end."""
    s = spans.withColumnRenamed(stream, "_s")
    hit = (fires[stream] == s["_s"]) & fires[fire].between(s[onset], s[offset] + tail)
    return fires.join(s, hit).drop("_s").withColumn("latency", F.col(fire) - F.col(offset))


class _Framer(_Kept):
    schema = "rest binary, number long"

    def __init__(self, length: int, hop: int, ring: int, every: int, idle: float | None):
        super().__init__(idle)
        self.length, self.hop, self.ring, self.every = length, hop, ring, every

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.frames = handle.getListState("frames", "frame binary", self.idle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = _in_order(rows, ["o"])
        rest, number = self.kept.get() or (b"", 0)
        x = np.concatenate([np.frombuffer(rest, float), *(np.asarray(s, float) for s in got["x"] if s is not None)])
        n = max(0, (len(x) - self.length) // self.hop + 1)
        new = x[np.arange(n)[:, None] * self.hop + np.arange(self.length)]
        before = self.ring - 1
        held = [np.frombuffer(f, float) for (f,) in self.frames.get()] if before and number else []
        ring = np.concatenate([np.array(held).reshape(-1, self.length), new])
        out = []
        for k in range(n):
            at = number + k  # the frame's number; it is asked for with the ring that it completes
            if at + 1 >= self.ring and (at + 1) % self.every == 0:
                end = len(held) + k + 1
                out.append((key[0], at, ring[end - self.ring : end].ravel()))
        if before and n:
            self.frames.put([(f.tobytes(),) for f in ring[-before:]])
        self.kept.update((x[n * self.hop :].tobytes(), number + n))
        yield pd.DataFrame(out, columns=["stream", "frame", "samples"])


def framer(df: DataFrame, stream: str, order: str, samples: str, length: int = 400, hop: int = 320, ring: int = 1, every: int = 1, idle: float | None = None) -> DataFrame:
    """stream, frame (number), samples: frames cut from chunks of any size; what doesn't fill a frame waits in the state.

    With a ``ring`` the last so many frames are put out together, one after another, once there are so many; with
    ``every`` only where the number of frames so far divides by it: 49 and 10 are a detector that sees 49 frames, asked after each tenth.
    """
    _prepared(df)
    rows = df.selectExpr(f"cast(`{stream}` as long) as stream", f"cast(`{order}` as long) as o", f"cast(`{samples}` as array<double>) as x")
    return _run(rows, _Framer(length, hop, ring, every, idle), "stream long, frame long, samples array<double>", "append")


class _Utterances(StatefulProcessor):
    """An open utterance a stream, and a timer at which silence ends it."""

    def __init__(self, silence: float, cap: float, before: float):
        self.silence, self.cap, self.before = silence, cap, before

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "run double, first double, last double, n long, timer long")

    def _closed(self, key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], max(first - self.before, 0.0), last, n) for _, first, last, n in rows], columns=["stream", "start", "stop", "n"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        *now, timer = self.open.get() or (None,) * 5
        out = []
        for t in _in_order(rows, ["t"])["t"].tolist():
            run, first, last, n = now
            if n is not None and t - last <= self.silence and (t - run) // self.cap == (first - run) // self.cap:
                now = [run, first, t, n + 1]
                continue
            if n is not None:
                out.append(tuple(now))
            # Silence begins a new run; the cap only a new piece of the same one.
            now = [t if n is None or t - last > self.silence else run, t, t, 1]
        if timer is not None:
            self.handle.deleteTimer(timer)
        # A row that is late by less than the silence still belongs to the utterance.
        timer = int(np.floor((now[2] + self.silence) * 1000)) + 1
        self.handle.registerTimer(timer)
        self.open.update((*now, timer))
        yield self._closed(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        *now, _ = self.open.get()
        self.open.clear()
        yield self._closed(key, [tuple(now)])

    def close(self) -> None:
        pass


def utterances(df: DataFrame, stream: str, time: str, silence: float = 0.8, cap: float = 8.0, before: float = 0.5, late: str = "0 seconds") -> DataFrame:
    """stream, start, stop, n of active rows, as ``sequence.utterances`` has them: put out when a later row ends one, or when the watermark has passed its silence; the state goes with it.

    ``time`` is in seconds; rows later than ``late`` behind the watermark are left aside.
    """
    _prepared(df)
    rows = df.selectExpr(f"cast(`{stream}` as long) as stream", f"cast(`{time}` as double) as t").where("t is not null").withColumn("at", F.timestamp_micros(F.round(F.col("t") * 1e6).cast("long"))).withWatermark("at", late)
    # Rows of no stream move the watermark only; as the condition names the time, it isn't evaluated before the watermark.
    return _run(rows.where("stream is not null or at is null"), _Utterances(silence, cap, before), "stream long, start double, stop double, n long", "append")


def replay(df: DataFrame, spark: SparkSession, path: str, name: str, mode: str = "append") -> DataFrame:
    """Runs a streaming frame over all that is there and returns what it put out, from a table in memory."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", path).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
