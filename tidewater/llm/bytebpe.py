"""A byte-level BPE vocabulary read from a tokenizers JSON file, and exact encoders of one pre-token."""

from __future__ import annotations

import functools
import json
from heapq import heapify, heappop, heappush

import regex

#: Fixed value: the pre-token pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
split = regex.compile(PATTERN).findall


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable ones for themselves, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, letters = file["model"], byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: bytes(byte_of[c] for c in s) for s, i in ids.items() if s not in self.special}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.byte_id = [ids[c] for c in letters]
        #: (left, right) -> (rank, merged), and the parts that make each token.
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = dict.fromkeys(self.byte_id, -1)
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            left, right, whole = ids[a], ids[b], ids[a + b]
            self.merges.setdefault((left, right), (r, whole))
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = (left, right), r

    def merge(self, raw: bytes) -> list[int]:
        """The ids of one pre-token: the pair of least rank is merged, the leftmost first, until none is left."""
        seq = [self.byte_id[b] for b in raw]
        n, get = len(seq), self.merges.get
        # What may be merged lies in a heap by rank and place; what a merge has made untrue is passed over when it comes up.
        heap = [(m[0], i) for i, p in enumerate(zip(seq, seq[1:])) if (m := get(p))]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if seq[i] < 0 or j >= n or not (m := get((seq[i], seq[j]))) or m[0] != rank:
                continue
            seq[i], seq[j] = m[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := get((seq[i], seq[k])):
                    heappush(heap, (m[0], i))
            if (h := before[i]) >= 0 and (m := get((seq[h], seq[i]))):
                heappush(heap, (m[0], h))
        return [t for t in seq if t >= 0]

    @functools.cached_property
    def alone(self) -> set[str]:
        """The strings proven to encode as one token: their own merge ends in it, and the pattern keeps them whole."""
        out = set()
        for i, raw in self.bytes_of.items():
            if i in self.special.values():
                continue
            try:
                s = raw.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if split(s) == [s] and self.merge(raw) == [i]:
                out.add(s)
        return out

    def between_specials(self, piece: str) -> list[tuple[str, int | None]]:
        """(text, special token after it): special strings in a text become their tokens, longest first, as in the library."""
        if not any(s in piece for s in self.special):
            return [(piece, None)]
        out, at = [], 0
        for m in regex.finditer("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)), piece):
            out.append((piece[at : m.start()], self.special[m[0]]))
            at = m.end()
        return [*out, (piece[at:], None)]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
