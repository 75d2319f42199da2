"""Best-fit packing of token documents into sequences, improved by a swap-based local search.

Only the number of pieces of each length (at most ``capacity`` of them) goes to the driver. Bins
of equal content are one pattern with a multiplicity, so the plan's size follows the capacity
and not the corpus. Best fit in falling order of length gives the first plan. The search then
moves documents and exchanges one for one, two for one or one for two between underfull bins
where that raises the sum of squared fills, until the bound ceil(ids / capacity) is reached or no
pair of underfull bins has such an exchange left.
Pieces find their places in parallel: each knows its rank among the pieces of its length.

Defined cases: a null text is empty, and an empty text is one piece holding just the end id;
repeated rows are packed each by itself, with their rank as tie-break; an empty table gives an
empty one; columns other than the two named are not read; a text longer than the capacity is cut
into full pieces and a last one that may be shorter.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytebpe
from .common import lean, two_columns, written
from .library_ids import library_ids

#: Partners that are compared at once for one underfull pattern; further ones follow where none of these gains.
PARTNERS = 64

Pattern = tuple[int, ...]


def best_fit(counts: dict[int, int], capacity: int) -> Counter[Pattern]:
    """Best fit decreasing over counts by length: pattern (falling lengths) -> bins."""
    done: Counter[Pattern] = Counter()
    room: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)  # residual -> patterns with it
    rooms: list[int] = []

    def put(pattern: Pattern, residual: int, bins: int) -> None:
        if not bins:
            return
        if not residual:
            done[pattern] += bins
        else:
            if not room[residual]:
                insort(rooms, residual)
            room[residual].append((pattern, bins))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                each = capacity // length
                bins, over = divmod(left, each)
                put((length,) * each, capacity - each * length, bins)
                if over:
                    put((length,) * over, capacity - over * length, 1)
                break
            residual = rooms[i]
            pattern, bins = room[residual].pop()
            if not room[residual]:
                rooms.pop(i)
            each = min(residual // length, left)
            filled = min(bins, left // each)
            put(pattern, residual, bins - filled)
            put(pattern + (length,) * each, residual - each * length, filled)
            left -= each * filled
    for residual, patterns in room.items():
        for pattern, bins in patterns:
            done[pattern] += bins
    return done


@lru_cache(1 << 14)
def _sums(pattern: Pattern) -> tuple[dict[int, Pattern], dict[int, Pattern], int, int]:
    """Sums of one document and of two with the documents behind them; and as bits, those of none or one and those of two."""
    own = sorted(set(pattern))
    one = {x: (x,) for x in own}
    two = {x + z: (x, z) for i, x in enumerate(own) for z in own[i:] if x != z or pattern.count(x) > 1}
    return one, two, sum(1 << x for x in one) | 1, sum(1 << x for x in two)


def _exchange(low: Pattern, high: Pattern, room: int) -> tuple[int, Pattern, Pattern]:
    """The best gain of ``high`` within ``room``: (gain, documents it gets, documents it gives)."""
    best: tuple[int, Pattern, Pattern] = (0, (), ())
    one, two, _, _ = _sums(low)
    theirs, their_twos, few, pairs = _sums(high)
    # Move and one for one; two for none and two for one; one for two: for each sum the least to give that leaves room.
    for gets, gives, behind in ((one, few, theirs), (two, few, theirs), (one, pairs, their_twos)):
        for s, get in gets.items():
            over = max(0, s - room)
            fits = gives >> over
            give = over + (fits & -fits).bit_length() - 1
            if fits and s - give > best[0]:
                best = (s - give, get, behind[give] if give else ())
        if best[0] == room:
            break
    return best


def _changed(pattern: Pattern, minus: Pattern, plus: Pattern) -> Pattern:
    out = list(pattern)
    for x in minus:
        out.remove(x)
    return tuple(sorted(out + list(plus), reverse=True))


def improve(bins: Counter[Pattern], capacity: int) -> Counter[Pattern]:
    """The local search; the multiset of lengths stays as it is."""
    bins = Counter(bins)
    total = sum(sum(p) * n for p, n in bins.items())
    least = -(-total // capacity)
    number = sum(bins.values())
    under = sorted((sum(p), p) for p in bins if sum(p) < capacity)  # the emptiest first
    made: list[Pattern] = []  # underfull patterns in the order in which bins came to them
    stuck: dict[Pattern, int] = {}  # patterns without a gaining partner, and how many had been made by then

    def change(pattern: Pattern, by: int) -> None:
        nonlocal number
        if not pattern:
            number -= by
            return
        before = bins[pattern]
        bins[pattern] += by
        if not bins[pattern]:
            del bins[pattern]
        if sum(pattern) < capacity:
            if by > 0:
                made.append(pattern)
            if not before:
                insort(under, (sum(pattern), pattern))
            elif pattern not in bins:
                under.pop(bisect_left(under, (sum(pattern), pattern)))

    while number > least:
        low = next((p for _, p in under if stuck.get(p, -1) < len(made)), None)
        if low is None:
            break
        own = (sum(low), low)
        if low in stuck:  # only those made since then
            partners = sorted(x for p in set(made[stuck[low] :]) if p in bins and (x := (sum(p), p)) >= own)
        else:
            partners = under[bisect_left(under, own) :]
        choice = None
        for k, (fill, high) in enumerate(partners):
            if choice is not None and k % PARTNERS == 0:
                break
            if high == low and bins[low] < 2:
                continue
            room = capacity - fill
            gain, get, give = _exchange(low, high, room)
            if gain and (choice is None or room - gain < choice[0]):
                choice = (room - gain, high, get, give)
                if gain == room:
                    break
        if choice is None:
            stuck[low] = len(made)
            continue
        _, high, get, give = choice
        n = bins[low] // 2 if low == high else min(bins[low], bins[high])
        change(low, -n)
        change(high, -n)
        change(_changed(high, give, get), n)
        if rest := _changed(low, get, give):
            change(rest, n)
        else:
            number -= n
    return bins


def plan(counts: dict[int, int], capacity: int) -> Counter[Pattern]:
    return improve(best_fit(counts, capacity), capacity)


def slots(bins: Counter[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (first rank, first sequence_id, offset) of each run of places for pieces of that length."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    taken: Counter[int] = Counter()
    sequence = 0
    for pattern in sorted(bins, reverse=True):
        offset = 0
        for length in pattern:
            runs[length].append((taken[length], sequence, offset))
            taken[length] += bins[pattern]
            offset += length
        sequence += bins[pattern]
    return {length: tuple(np.array(r, np.int64).T) for length, r in runs.items()}


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32, and part and rank (among the part's pieces of that length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = library_ids(path or bytebpe.tokenizer_path("word_bpe_49k.json"), False)
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for first, last, ids, ends in encode.batches(batch.column("text")):
                raw = memoryview(np.insert(ids, ends, np.uint32(end_id)).astype("<u4").tobytes())
                rows, begin = [], 0
                for doc_id, end in zip(doc_ids[first:last], (ends + np.arange(1, last - first + 1)).tolist()):
                    for piece, at in enumerate(range(begin, end, capacity)):
                        n = min(capacity, end - at)
                        rows.append((doc_id, piece, at - begin, n, zlib.crc32(raw[4 * at : 4 * (at + n)]), seen[n]))
                        seen[n] += 1
                    begin = end
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*rows), kinds)), pa.array([part] * len(rows), pa.int32())], ["doc_id", "piece", "start", "length", "ids_crc32", "rank", "part"])

    return two_columns(docs, id_col, text_col).mapInArrow(lean(run, remembers=True), "doc_id long, piece int, start long, length long, ids_crc32 long, rank long, part int")


def pack(docs: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces = written(token_pieces(docs, path, capacity, end_id, id_col, text_col), "pieces")
    counts = written(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    places = pieces.sparkSession.sparkContext.broadcast(slots(plan(by_length, capacity)))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy() + batch.column("before").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for at in np.split(order, cuts) if len(order) else ():
                first, base, place = places.value[int(length[at[0]])]
                k = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at], offset[at] = base[k] + rank[at] - first[k], place[k]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    # Sorted and merged: a broadcast of it would grow with the parts.
    return pieces.join(before.hint("merge"), ["part", "length"]).mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
