"""Operators over ordered series: votes, refractory holds, islands, gaps, spans, deciles.

Series are keyed by ``stream`` and ordered by time and a tie key. A stream's rows meet in one task
where the result of a row depends on the rows before it; a hold's rows meet by ranges of time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..functions.tables import written

#: Holds that a range of time spans, within which a stream's firings are one task's work.
HOLDS = 64


def vote(df: DataFrame, stream: str, order: Sequence[str], hit: str, m: int = 2, n: int = 3, to: str = "voted") -> DataFrame:
    """Whether at least ``m`` of the trailing ``n`` rows are hits; the frame is shorter at the start."""
    frame = Window.partitionBy(stream).orderBy(*order).rowsBetween(-(n - 1), 0)
    return df.withColumn(to, F.sum(F.col(hit).cast("int")).over(frame) >= m)


def refractory(df: DataFrame, stream: str, time: str, tie: str, hold: float, condition: str = "voted") -> DataFrame:
    """stream, fire, fired_tie: candidate rows at least ``hold`` after the last one that fired.

    The state depends on the operator's own output, yet one stream is many tasks' work: time is cut into ranges of ``HOLDS``
    holds, and each range is a function from the last firing before it to the last one in it. Chains of firings that begin
    at different rows soon run together, so a function has few steps. The functions of a stream are composed in order; then each range fires by itself.
    """
    ship(df.sparkSession)
    kind = df.schema[stream].dataType.simpleString()
    rows = df.where(condition).select(F.col(stream).alias("s"), F.col(time).cast("double").alias("t"), F.col(tie).cast("long").alias("k")).where("t is not null")
    named = (F.col("s").alias(stream), F.col("t").alias("fire"), F.col("k").alias("fired_tie"))
    if hold <= 0:
        return rows.select(*named)
    rows = written(rows.withColumn("range", F.floor(F.col("t") / (HOLDS * hold)).cast("long")), "candidates")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            upper, end = _hold_function(group.column("t").to_numpy(), hold)
            yield pa.RecordBatch.from_arrays([group.column("s")[:1], group.column("range")[:1], pa.array([upper], pa.list_(pa.float64())), pa.array([end], pa.list_(pa.float64()))], ["s", "range", "upper", "end"])

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            before = []
            for s, upper, end in zip(batch.column("s").to_pylist(), batch.column("upper"), batch.column("end")):
                if (s,) != now:
                    now, last = (s,), None
                before.append(last)
                upper, end = upper.values.to_numpy(), end.values.to_numpy()
                at = 0 if last is None else _first_after(upper, last, hold, 0)
                last = float(end[at]) if at < len(end) else last
            yield pa.RecordBatch.from_arrays([batch.column("s"), batch.column("range"), pa.array(before, pa.float64())], ["s", "range", "t"])

    def fired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            last, t = group.column("t")[0].as_py(), group.column("t").to_numpy(zero_copy_only=False)  # the first row is the last firing before
            at, out = 1 if last is None else _first_after(t, last, hold, 1), []
            while at < len(t):
                out.append(at)
                at = _first_after(t, t[at], hold, at + 1)
            yield group.take(pa.array(out, pa.int64())).select(["s", "t", "k"])

    made = rows.repartition(n, "s", "range").sortWithinPartitions("s", "range", "t", "k").mapInArrow(functions, f"s {kind}, range long, upper array<double>, end array<double>")
    before = made.repartition(n, "s").sortWithinPartitions("s", "range").mapInArrow(composed, f"s {kind}, range long, t double")
    both = rows.withColumn("own", F.lit(True)).unionByName(before.select("s", "range", "t", F.lit(None).cast("long").alias("k"), F.lit(False).alias("own")))
    both = both.repartition(n, "s", "range").sortWithinPartitions("s", "range", "own", "t", "k")
    return both.mapInArrow(fired, f"s {kind}, t double, k long").select(*named)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each stream and range, from sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = [batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy() for c in ("s", "range")]
        at = [0, *(np.flatnonzero((np.diff(codes[0]) != 0) | (np.diff(codes[1]) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(at, at[1:]):
            part = batch.slice(a, b - a)
            if held and any(held[0].column(c)[0] != part.column(c)[0] for c in ("s", "range")):
                yield pa.concat_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_batches(held)


def _first_after(t: np.ndarray, last: float, hold: float, begin: int) -> int:
    """The first place from ``begin`` on whose time is at least ``hold`` after the last firing, by the difference of the two."""
    at = begin + int(np.searchsorted(t[begin:], last + hold))
    while at > begin and t[at - 1] - last >= hold:
        at -= 1
    while at < len(t) and t[at] - last < hold:
        at += 1
    return at


def _hold_function(t: np.ndarray, hold: float) -> tuple[np.ndarray, np.ndarray]:
    """Steps of a range's function: of rows in order that lead to one last firing, the last one's time; and that firing."""
    n = len(t)
    after = np.searchsorted(t, t + hold)
    while len(some := np.flatnonzero((after > np.arange(n) + 1) & (t[np.maximum(after - 1, 0)] - t >= hold))):
        after[some] -= 1
    while len(some := np.flatnonzero((after < n) & (t[np.minimum(after, n - 1)] - t < hold))):
        after[some] += 1
    end = np.where(after < n, after, np.arange(n))
    while ((further := end[end]) != end).any():
        end = further
    change = np.append(np.flatnonzero(np.diff(end)), n - 1)
    return t[change], t[end[change]]


def spans_matched(spans: DataFrame, fires: DataFrame, stream: str, onset: str, offset: str, fire: str, tail: float) -> DataFrame:
    """Every span with the first firing between its onset and its offset + ``tail``: detected, first_fire, latency.

    Time is cut into cells as long as the mean span, so the interval join is an equi-join on stream and cell, and
    spans fall into three cells each at most on average, however long one of them is.
    """
    mean = spans.agg(F.avg(F.col(offset) + tail - F.col(onset)).alias("w")).first()["w"]
    width = max(float(mean or 0), 1e-9)
    cell = lambda c: F.floor(c / width)
    s = spans.withColumn("_cell", F.explode(F.sequence(cell(F.col(onset)), cell(F.col(offset) + tail))))
    f = fires.select(F.col(stream).alias("_s"), F.col(fire).alias("_f")).withColumn("_c", cell(F.col("_f")))
    hit = (s[stream] == f["_s"]) & (s["_cell"] == f["_c"]) & f["_f"].between(s[onset], s[offset] + tail)
    keys = [c for c in spans.columns]
    out = s.join(f, hit, "left").groupBy(*keys).agg(F.min("_f").alias("first_fire"))
    return out.select(*keys, F.col("first_fire").isNotNull().alias("detected"), "first_fire", F.round(F.col("first_fire") - F.col(offset), 6).alias("latency"))


def longest_island(df: DataFrame, stream: str, index: str, gap: int) -> DataFrame:
    """By stream the longest run of index values whose steps are at most ``gap``: start, stop, length; the first of equals."""
    order = Window.partitionBy(stream).orderBy(index)
    new = F.when(F.col(index) - F.lag(index).over(order) > gap, 1).otherwise(0)
    runs = df.select(stream, index).withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(stream, "_run").agg(F.min(index).alias("start"), F.max(index).alias("stop")).withColumn("length", F.col("stop") - F.col("start") + 1)
    return runs.groupBy(stream).agg(F.max(F.struct("length", (-F.col("start")).alias("s"), "stop")).alias("top")).select(stream, (-F.col("top.s")).alias("start"), "top.stop", "top.length")


def longest_zero_run(df: DataFrame, stream: str, order: Sequence[str], zero: str) -> DataFrame:
    """By stream the longest run of consecutive rows under a condition; 0 if there is none."""
    all_, own = Window.partitionBy(stream).orderBy(*order), Window.partitionBy(stream, "_z").orderBy(*order)
    marked = df.withColumn("_z", F.expr(zero)).withColumn("_island", F.row_number().over(all_) - F.row_number().over(own))
    runs = marked.groupBy(stream, "_z", "_island").agg(F.count("*").alias("n"))
    return runs.groupBy(stream).agg(F.coalesce(F.max(F.when(F.col("_z"), F.col("n"))), F.lit(0)).alias("longest"))


def sequence_gaps(df: DataFrame, stream: str, sequence: str, first: int = 0) -> DataFrame:
    """By stream: positive gaps in the sequence, and how many numbers they skip; ``first`` is expected at the start."""
    order = Window.partitionBy(stream).orderBy(sequence)
    skipped = F.col(sequence) - F.coalesce(F.lag(sequence).over(order) + 1, F.lit(first))
    return df.select(stream, F.greatest(skipped, F.lit(0)).alias("_g")).groupBy(stream).agg(F.count_if(F.col("_g") > 0).alias("gaps"), F.sum("_g").alias("lost"))


def decile_levels(df: DataFrame, stream: str, value: str) -> DataFrame:
    """By stream the mean of the lowest and the highest max(1, n // 10) values, and their ratio in dB."""
    place, size = F.row_number().over(Window.partitionBy(stream).orderBy("v")), F.count("*").over(Window.partitionBy(stream))
    ranked = df.select(stream, F.col(value).alias("v")).withColumns({"_a": place, "_n": size}).select(stream, "v", "_a", (F.col("_n") - F.col("_a") + 1).alias("_d"), F.greatest(F.lit(1), F.floor(F.col("_n") / 10)).alias("_k"))
    out = ranked.groupBy(stream).agg(F.avg(F.when(F.col("_a") <= F.col("_k"), F.col("v"))).alias("low"), F.avg(F.when(F.col("_d") <= F.col("_k"), F.col("v"))).alias("high"))
    return out.select(stream, F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round(10 * F.log10(F.greatest("high", F.lit(1e-12)) / F.greatest("low", F.lit(1e-12))), 6).alias("snr_db"))


def truncated(df: DataFrame, stream: str, index: str, active: str, margin: int) -> DataFrame:
    """By stream whether the last active row lies within ``margin`` rows of the end."""
    return df.groupBy(stream).agg(F.max(index).alias("last"), F.max(F.when(F.expr(active), F.col(index))).alias("last_active")).select(stream, F.coalesce(F.col("last") - F.col("last_active") < margin, F.lit(False)).alias("truncated"))


def cadence(df: DataFrame, stream: str, order: Sequence[str], context: int = 49, every: int = 10) -> DataFrame:
    """The rows at which a detector of so long a context is asked: number n >= context and divisible by ``every``."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(stream).orderBy(*order))).where((F.col("n") >= context) & (F.col("n") % every == 0))


def spurious(spans: DataFrame, fires: DataFrame, stream: str, onset: str, offset: str, fire: str, tail: float) -> DataFrame:
    """By stream: firings, and those within no span (its onset to its offset + ``tail``)."""
    mean = spans.agg(F.avg(F.col(offset) + tail - F.col(onset)).alias("w")).first()["w"]
    width = max(float(mean or 0), 1e-9)
    s = spans.select(F.col(stream).alias("_s"), F.col(onset).alias("_on"), (F.col(offset) + tail).alias("_off"))
    s = s.withColumn("_c", F.explode(F.sequence(F.floor(F.col("_on") / width), F.floor(F.col("_off") / width))))
    f = fires.withColumn("_cell", F.floor(F.col(fire) / width))
    inside = (f[stream] == s["_s"]) & (f["_cell"] == s["_c"]) & f[fire].between(s["_on"], s["_off"])
    outside = f.join(s, inside, "left_anti").groupBy(stream).agg(F.count("*").alias("n"))
    return fires.groupBy(stream).agg(F.count("*").alias("n_fires")).join(outside, stream, "left").select(stream, "n_fires", F.coalesce("n", F.lit(0)).alias("n_spurious"))


def utterances(df: DataFrame, stream: str, time: str, silence: float = 0.8, cap: float = 8.0, before: float = 0.5) -> DataFrame:
    """stream, start, stop, n of active rows: an utterance ends after ``silence`` seconds without one, or ``cap`` seconds after its
    first row, when the next begins; ``start`` lies ``before`` seconds ahead of its first row (not before 0)."""
    order = Window.partitionBy(stream).orderBy(time)
    new = (F.col(time) - F.lag(time).over(order) > silence).cast("int")
    runs = df.select(stream, time).withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.withColumn("_piece", F.floor((F.col(time) - F.min(time).over(Window.partitionBy(stream, "_run"))) / cap))
    out = runs.groupBy(stream, "_run", "_piece").agg(F.min(time).alias("_a"), F.max(time).alias("stop"), F.count("*").alias("n"))
    return out.select(stream, F.greatest(F.col("_a") - before, F.lit(0.0)).alias("start"), "stop", "n")
