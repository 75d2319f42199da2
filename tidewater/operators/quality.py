"""Quality rules over records: arrays of failures and warnings, first-match verdicts, near copies of vectors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..functions.tables import written

#: Rows of a block of vectors, on average, where there are few; bytes of a block's numbers at most, and blocks that more rows are cut into until then.
BLOCK, BLOCK_BYTES, BLOCKS = 2000, 16 << 20, 16
#: Pivots at most; rows that are looked at together; comparisons that cost as much as moving a row; tasks that blocks meet in at most.
PIVOTS, TILE, MOVED, TASKS = 1024, 1024, 2000, 1000


def rule_flags(df: DataFrame, fails: dict[str, Column], warns: dict[str, Column]) -> DataFrame:
    """Adds fails, warns (arrays of rule names, in order) and status (fail > warn > ok). A rule on nulls doesn't fire."""
    of = lambda rules: F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))
    out = df.withColumns({"fails": of(fails), "warns": of(warns)})
    return out.withColumn("status", F.when(F.size("fails") > 0, "fail").when(F.size("warns") > 0, "warn").otherwise("ok"))


def first_match(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """The name of the first rule that holds."""
    out = F.lit(default)
    for condition, name in reversed(rules):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def bits(df: DataFrame, group: str, *columns: str) -> DataFrame:
    """By group the OR, AND and XOR over a column's bits, and whether every and any value is odd."""
    out = []
    for c in columns:
        x = F.col(c).cast("long")
        out += [F.bit_or(x).alias(f"{c}_or"), F.bit_and(x).alias(f"{c}_and"), F.bit_xor(x).alias(f"{c}_xor"), F.bool_and(x.bitwiseAND(F.lit(1)) == 1).alias(f"{c}_all_odd"), F.bool_or(x.bitwiseAND(F.lit(1)) == 1).alias(f"{c}_any_odd")]
    return df.groupBy(group).agg(*out)


def near_vectors(df: DataFrame, key: str, vector: str, threshold: float, block: int | None = None) -> DataFrame:
    """a, b, cosine: pairs of vectors whose cosine, after the corpus mean is removed, reaches the threshold. Exact; rows without a vector take no part.

    Each row belongs to the nearest of some pivots. A row within the angle of the threshold of another lies no further
    from the other's pivot than from its own by twice that angle, and within the angle of that pivot's furthest row: it
    visits only such pivots. A pivot's rows are dealt into parts of about ``block`` rows, its visitors into chunks of as many, and a part meets
    one other part or one chunk at a time, so that a task's memory doesn't grow with the rows. The higher the threshold, the fewer visits; where
    they would cost more than they save, all rows belong to one pivot, and every two parts meet.
    """
    return _met(*_dealt(df, key, vector, threshold, block), threshold)


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1, 1))


def _vectors(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().astype(float).reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _dealt(df: DataFrame, key: str, vector: str, threshold: float, block: int | None = None) -> tuple[DataFrame, int]:
    """Rows id, v (unit), pivot, x, y, chunk, part: what meets where, a task's together; and the number of dimensions. ``part`` is a row's own part of the pivot, or -1 for a visitor."""
    ship(df.sparkSession)
    dims = df.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = np.array([r["m"] for r in dims.orderBy("i").collect()])  # one number a dimension
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    n = rows.count()
    some = rows.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, max(1, -(-4 * n // (block or BLOCK))))).toArrow()  # PIVOTS rows at most
    pivots = _units(_vectors(some["v"]) - mean) if len(some) else np.zeros((0, len(mean)))
    block = block or max(BLOCK, min(-(-n // BLOCKS), BLOCK_BYTES // (8 * max(1, len(mean)))))
    angle = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for batch in batches:
            for a in range(0, len(batch), TILE):
                own = batch.slice(a, TILE)
                unit = _units(_vectors(own.column("v")) - mean)
                yield own, unit, _angles(unit, pivots)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, d in sliced(batches):
            yield pa.RecordBatch.from_arrays([pa.array(d.argmin(axis=1)), pa.array(d.min(axis=1))], ["pivot", "d"])

    found = rows.mapInArrow(near, "pivot long, d double").groupBy("pivot").agg(F.count("*").alias("n"), F.max("d").alias("far")).collect()  # a row a pivot
    count, far, visitors = np.zeros(len(pivots), np.int64), np.full(len(pivots), -10.0), np.zeros(len(pivots), np.int64)
    for r in found:
        count[r["pivot"]], far[r["pivot"]] = r["n"], r["far"]

    def visited(d: np.ndarray) -> np.ndarray:
        """Earlier pivots than a row's own that may hold a partner."""
        return (d <= np.minimum(d.min(axis=1)[:, None] + 2 * angle, far + angle)) & (np.arange(len(pivots)) < d.argmin(axis=1)[:, None])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(pivots), np.int64)
        for _, _, d in sliced(batches):
            seen += visited(d).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pivots))), pa.array(seen)], ["pivot", "n"])

    for r in rows.mapInArrow(visits, "pivot long, n long").groupBy("pivot").agg(F.sum("n").alias("n")).collect():  # a row a pivot
        visitors[r["pivot"]] = r["n"]
    parts, chunks = np.maximum(1, -(-count // block)), np.maximum(1, -(-visitors // block))
    moved, compared = int((count * (parts - 1 + chunks) + visitors * parts).sum()), float((count * (count / 2 + visitors)).sum())
    if MOVED * moved + compared > MOVED * n * -(-n // block) + n * n / 2:
        pivots, parts, chunks = pivots[:1], np.array([-(-n // block)]), np.ones(1, np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, unit, d in sliced(batches):
            home, hashed = d.argmin(axis=1), batch.column("hash").to_numpy()
            # A row meets every part of its own pivot, every chunk of visitors in its own part, and every part of the pivots it visits.
            at = np.arange(len(batch))
            place, pivot = np.nonzero(visited(d)) if len(pivots) > 1 else (at[:0], at[:0])
            visit = [np.repeat(c, parts[pivot]) for c in (place, pivot, hashed[place] % chunks[pivot])]
            met = _upto(parts[pivot])
            own, other = np.repeat(at, parts[home]), _upto(parts[home])
            part = (hashed % parts[home])[own]
            times = np.where(part == other, chunks[home[own]], 1)
            own, other, part, chunk = np.repeat(own, times), np.repeat(other, times), np.repeat(part, times), _upto(times)
            columns = (own, visit[0]), (home[own], visit[1]), (np.minimum(part, other), met), (np.maximum(part, other), met), (chunk, visit[2]), (part, np.full(len(met), -1))
            place, *columns = (np.concatenate(c) for c in columns)
            for a in range(0, len(place), 4 * TILE):
                s = slice(a, a + 4 * TILE)
                v = pa.FixedSizeListArray.from_arrays(pa.array(unit[place[s]].ravel()), unit.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(place[s])), v, *(pa.array(c[s]) for c in columns)], ["id", "v", *_MEET, "part"])

    hashed = rows.withColumn("hash", F.pmod(F.xxhash64("id"), F.lit(1 << 31)))
    meetings = int((parts * (parts - 1) // 2 + parts * chunks).sum())
    dealt = hashed.mapInArrow(deal, "id long, v array<double>, pivot long, x long, y long, chunk long, part long")
    return dealt.repartition(max(1, min(meetings, TASKS)), *_MEET), len(mean)


#: What rows have in common that meet.
_MEET = ("pivot", "x", "y", "chunk")


def _upto(times: np.ndarray) -> np.ndarray:
    """0, 1, ... below each number, one after another."""
    return np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)


def _met(rows: DataFrame, dims: int, threshold: float) -> DataFrame:
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, ids, units = [], [], []
        for batch in batches:
            x, y, chunk = (batch.column(c)[0].as_py() for c in _MEET[1:])
            parts.append(batch.column("part").to_numpy())
            ids.append(batch.column("id").to_numpy())
            units.append(_vectors(batch.column("v")).reshape(-1, dims))
        part, ids, unit = np.concatenate(parts), np.concatenate(ids), np.concatenate(units)
        units.clear()
        a, b = np.flatnonzero(part == x), np.flatnonzero(part == y) if x != y else np.flatnonzero((part < 0) | ((part == x) & (chunk == 0)))
        for i in range(0, len(a), TILE):
            left = a[i : i + TILE]
            for j in range(0, len(b), TILE):
                right = b[j : j + TILE]
                cosine = (unit[left] @ unit[right].T).ravel()
                place = np.flatnonzero(cosine >= threshold)
                one, two = left[place // len(right)], right[place % len(right)]
                keep = (ids[one] != ids[two]) & ((part[two] < 0) | (x != y) | (ids[one] < ids[two]))
                if keep.any():
                    one, two = ids[one[keep]], ids[two[keep]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two)), pa.array(cosine[place[keep]])], ["a", "b", "cosine"])

    return rows.groupBy(*_MEET).applyInArrow(pairs, "a long, b long, cosine double")


def sidecar(df: DataFrame, side: DataFrame, key: str, json: str, schema: str) -> DataFrame:
    """Left join with optional JSON sidecars: the parsed struct, or null, and why (missing, malformed, ok)."""
    parsed = side.select(key, F.col(json).alias("_raw"), F.from_json(json, schema).alias("side"))
    out = df.join(parsed, key, "left")
    state = F.when(F.col("_raw").isNull(), "missing").when(F.col("side").isNull() | F.forall(F.array(*(F.col(f"side.{f.name}").isNull() for f in parsed.schema["side"].dataType.fields)), lambda x: x), "malformed").otherwise("ok")
    return out.withColumn("side_state", state).drop("_raw")


def content_class(declared: Column, name: Column, patterns: dict[str, str], default: str) -> Column:
    """What the sidecar declares; else by the first pattern that the file name matches; else the default."""
    out = F.lit(default)
    for label, pattern in reversed(patterns.items()):
        out = F.when(name.rlike(pattern), F.lit(label)).otherwise(out)
    return F.coalesce(declared, out)




def kept_and_dropped(df: DataFrame, reasons: dict[str, Column], name: str = "drops") -> tuple[DataFrame, Observation]:
    """The rows that no reason drops, and how many were read, kept, and dropped by which reason (the first that holds): known once the rows have been written or collected, from the same pass."""
    why = first_match([(F.coalesce(c, F.lit(False)), k) for k, c in reasons.items()], "")
    seen = Observation(name)
    marked = df.withColumn("_why", why)
    counts = [F.count("*").alias("read"), F.count_if(F.col("_why") == "").alias("kept"), *(F.count_if(F.col("_why") == k).alias(k) for k in reasons)]
    return marked.observe(seen, *counts).where("_why = ''").drop("_why"), seen


def drop_counts(df: DataFrame, reasons: dict[str, Column], what: str = "kept") -> tuple[DataFrame, DataFrame]:
    """The kept rows, written, and their account: reason (read, kept, or why a row was dropped) and n."""
    kept, seen = kept_and_dropped(df, reasons, f"{what}-{uuid.uuid4().hex}")
    kept = written(kept, what)
    return kept, df.sparkSession.createDataFrame([(k, int(n)) for k, n in seen.get.items()], "reason string, n long")
