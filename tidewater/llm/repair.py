"""Token-id files under a Re-Pair grammar.

Ids are cut into shards of whole documents. In each, frequent adjacent pairs are replaced by
nonterminals again and again; pairs never cross a document's end. A round replaces many pairs at
once: none of them has as its left symbol what another has as its right, so no two occurrences
overlap; of a pair of equal symbols every other place in a run takes part. Rounds go on until no
pair has ``LEAST`` places. A shard is one row of a Parquet file in the shared folder:

    part, shard            place of the shard: ascending range of doc_id, then number in it
    start, n_ids           ids in the same part before this shard, and in it
    first_id, last_id      the least and the largest doc_id in it
    doc_ids, ends          int64 per document: its id, and where it ends in ``sequence`` (symbols)
    lengths                int64 per document: its ids, end id included
    alphabet               uint32: the ids behind the first symbols
    rules                  uint32 pairs: the two symbols behind each further symbol
    expansion              uint32 per symbol: how many ids it stands for
    sequence, width        the symbols, unsigned little-endian of ``width`` bytes

Decoding one document needs the rules and its own slice of the sequence.
"""

from __future__ import annotations

import numpy as np

#: Pairs replaced in a round, and the least count of a replaced pair.
PAIRS_A_ROUND, LEAST = 4096, 16
_HASH_BITS = 18


def _frequent(seq: np.ndarray, open_: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Non-overlapping frequent pairs (left, right), the places in ``seq`` where they stand, and which pair stands there."""
    slot = ((seq[:-1] * np.uint32(0x9E3779B1) ^ seq[1:] * np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - _HASH_BITS)).astype(np.intp)
    slot[np.flatnonzero(~open_)] = 1 << _HASH_BITS  # apart, and never frequent
    rough = np.bincount(slot, minlength=(1 << _HASH_BITS) + 1)
    rough[-1] = 0
    few = min(4 * PAIRS_A_ROUND, rough.size - 1)
    least = max(LEAST, int(np.partition(rough, rough.size - few)[rough.size - few]))
    at, pairs, counts = _counted(seq, (rough >= least)[slot], symbols)
    if least > LEAST and counts.max(initial=0) < LEAST:  # the fullest slots held rare pairs alone
        at, pairs, counts = _counted(seq, (rough >= LEAST)[slot], symbols)
    pairs, counts = pairs[counts >= LEAST], counts[counts >= LEAST]
    pairs = pairs[np.lexsort((pairs, -counts))][: 2 * PAIRS_A_ROUND]
    left, right = (pairs // np.uint64(symbols)).astype(np.uint32), (pairs % np.uint64(symbols)).astype(np.uint32)
    side = bytearray(symbols)  # 1: only as left symbol, 2: only as right, 3: only in a pair of its own
    chosen = []
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        if (not side[a]) if a == b else (side[a] < 2 and side[b] in (0, 2)):
            side[a], side[b] = (3, 3) if a == b else (1, 2)
            chosen.append(i)
            if len(chosen) == PAIRS_A_ROUND:
                break
    left, right = left[chosen], right[chosen]
    # By slot; of pairs in one slot the most frequent is replaced now, and the others in a later round.
    own = (left * np.uint32(0x9E3779B1) ^ right * np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - _HASH_BITS)
    _, alone = np.unique(own, return_index=True)
    alone.sort()
    left, right = left[alone], right[alone]
    table = np.full(1 << _HASH_BITS, -1, np.int32)
    table[own[alone]] = np.arange(len(alone), dtype=np.int32)
    which = table[slot[at]]
    some = which >= 0
    at, which = at[some], which[some]
    hit = (seq[at] == left[which]) & (seq[at + 1] == right[which])
    return left, right, at[hit], which[hit]


def _counted(seq: np.ndarray, where: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places marked in ``where``, and the distinct pairs there with their counts."""
    at = np.flatnonzero(where)
    kind = np.uint32 if symbols < 1 << 16 else np.uint64
    pairs, counts = np.unique(seq[at].astype(kind, copy=False) * kind(symbols) + seq[at + 1], return_counts=True)
    return at, pairs.astype(np.uint64), counts


def compress(ids: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """alphabet, rules, expansion, sequence and ends (in symbols) of ids whose documents end at ``ends``."""
    if len(ids) and int(ids.max()) < 1 << 20:
        alphabet = np.flatnonzero(np.bincount(ids))
        place = np.zeros(int(ids.max()) + 1, np.uint32)
        place[alphabet] = np.arange(len(alphabet))
        seq = place[ids]
    else:
        alphabet, seq = np.unique(ids, return_inverse=True)
        seq = seq.astype(np.uint32)
    expansion = np.ones(len(alphabet), np.int64)
    rules = np.empty((0, 2), np.int64)
    ends = ends.astype(np.int64)
    while len(seq) > 1:
        symbols = len(expansion)
        open_ = np.ones(len(seq), bool)
        open_[ends[ends > 0] - 1] = False
        equal = np.flatnonzero(open_[:-1] & (seq[:-1] == seq[1:]))
        fresh = np.append(True, np.diff(equal) != 1)[: len(equal)]
        rank = np.arange(len(equal)) - np.maximum.accumulate(np.where(fresh, np.arange(len(equal)), 0))
        open_[equal[rank % 2 == 1]] = False  # these overlap the place before
        left, right, at, which = _frequent(seq, open_[:-1], symbols)
        if not len(left):
            break
        seq[at] = (symbols + which).astype(np.uint32)
        ends = ends - np.searchsorted(at + 1, ends)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        rules = np.concatenate((rules, np.stack((left, right), 1).astype(np.int64)))
        expansion = np.concatenate((expansion, expansion[left] + expansion[right]))
    return {"alphabet": alphabet, "rules": rules, "expansion": expansion, "sequence": seq, "ends": ends}


class Grammar:
    """Decodes any slice of a shard's sequence."""

    def __init__(self, alphabet: np.ndarray, rules: np.ndarray, expansion: np.ndarray):
        self.length = expansion.astype(np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        self.flat = np.empty(int(self.length.sum()), np.uint32)
        n = len(alphabet)
        self.flat[:n] = alphabet
        done = n
        rules = rules.astype(np.int64)
        while done < len(self.length):  # symbols of one round need only those before it
            ready = rules[done - n :].max(axis=1) < done
            stop = done + (len(ready) if ready.all() else int(np.argmin(ready)))
            a, b = rules[done - n : stop - n].T
            out = np.stack((a, b), 1).ravel()
            self.flat[self.begin[done] : self.begin[stop - 1] + self.length[stop - 1]] = self.expand(out)
            done = stop

    def expand(self, sequence: np.ndarray) -> np.ndarray:
        """The ids that the symbols stand for."""
        sequence = sequence.astype(np.int64)
        length = self.length[sequence]
        total = int(length.sum())
        shift = np.repeat(self.begin[sequence] - (np.cumsum(length) - length), length)
        return self.flat[np.arange(total) + shift]


def packed(sequence: np.ndarray) -> tuple[bytes, int]:
    width = 2 if not len(sequence) or int(sequence.max()) < 1 << 16 else 4
    return sequence.astype(f"<u{width}").tobytes(), width
