"""Ids by the tokenizers library for runs of texts: each distinct word is asked once.

The vocabularies split a text into words by a fixed pattern before they merge. For texts of plain
letters and signs (Latin-1) that split is made here, for a whole run of texts at once and as array
operations; the words of the run are dictionary-encoded, and only those that the worker doesn't
remember go to the library's BPE model. A gather puts the ids of all words in their places. Any
other text (special strings, other letters, odd white space) is cut at spaces that a non-space
follows, where a word always begins, and its distinct pieces go through the library whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bytebpe import byte_letters
from .pieces import LONGEST_KEPT, cut

#: Bytes of text that are split together, and entries in a generation of a memory (under 250 bytes each).
RUN, REMEMBERED = 4 << 20, 500_000
LETTER, NUMBER, SIGN, WHITE = range(4)
#: What may follow an apostrophe as a word of its own, the earlier first.
_SHORT = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def _kind(code: int) -> int:
    c = chr(code)
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], WHITE if c.isspace() else SIGN)


_KINDS = np.array([_kind(c) for c in range(256)], np.uint8)
#: Bytes that make a text odd: control characters but tab and line feed, and those that begin a character beyond Latin-1.
_ODD = np.array([b < 32 and b not in (9, 10) or b == 127 or b >= 0xC4 for b in range(256)])
_LOWER = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 256 else c for c in range(256)], np.uint8)


def word_begins(data: np.ndarray, texts: np.ndarray, spaced: bool) -> np.ndarray:
    """Where the words of Latin-1 texts begin, which begin themselves at ``texts``.

    ``spaced``: a space goes with the word after it, and digits stay together. Otherwise white
    space is a word of its own (to be dropped) and so is every digit.
    """
    n = len(data)
    kind = _KINDS[data]
    first = np.zeros(n + 1, bool)
    first[texts] = True
    first[n] = True
    begins = np.ones(n, bool)
    before, now = kind[:-1], kind[1:]
    if spaced:
        white = now == WHITE
        # In white space the last of a run stands apart where a word follows; a space goes with that word.
        follows = np.zeros(n, bool)
        follows[:-1] = (now != WHITE) & ~first[1:n]
        begins[1:] = np.where(white, (before != WHITE) | follows[1:], np.where(before == WHITE, data[:-1] != 32, before != now))
    else:
        begins[1:] = (before != now) | (now == NUMBER)
    begins |= first[:n]
    quotes = np.flatnonzero((data[:-1] == 39) & begins[:-1] & (now == LETTER) & ~first[1:n]) if n > 1 else ()
    if len(quotes):
        # A lone apostrophe before letters; its word began here, so no space went with it.
        at, end = quotes + 1, texts_end(first, quotes)
        taken = np.zeros(len(quotes), np.int64)
        for short in _SHORT:
            same = (taken == 0) & (at + len(short) <= end)
            for k, b in enumerate(short):
                same &= data[np.minimum(at + k, n - 1)] == b
            taken[same] = len(short)
        at, taken = at[taken > 0], taken[taken > 0]
        begins[at] = False
        after = at + taken
        after = after[after < n]
        begins[after] |= kind[after] == LETTER  # other kinds begin there anyway
    return np.flatnonzero(begins)


def texts_end(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the texts end that hold the places ``at``."""
    ends = np.flatnonzero(first)
    return ends[np.searchsorted(ends, at, side="right")]


class Recent:
    """A bounded memory of ``work(key)``: two generations; what the older one still serves moves up."""

    def __init__(self, work: Callable, size: int = REMEMBERED):
        self.work, self.size, self.new, self.old = work, size, {}, {}

    def all(self, keys: list) -> list[bytes]:
        """``work`` of each of the distinct keys."""
        found = list(map(self.new.get, keys))
        old, work = self.old.get, self.work
        for k, x in enumerate(found):
            if x is None:
                key = keys[k]
                found[k] = x = old(key) or work(key)
                if len(key) <= LONGEST_KEPT:
                    if len(self.new) >= self.size:
                        self.old, self.new = self.new, {}
                        old = self.old.get
                    self.new[key] = x
        return found


class RunIds:
    """Whole texts to ids, given those of one word (its Latin-1 bytes) and those of any text, as little-endian unsigned 32-bit integers.

    ``spaced``: a word keeps its leading space (byte-level vocabularies). Otherwise the
    vocabulary lower-cases and drops white space, and a text may be cut at every space.
    """

    def __init__(self, spaced: bool, special: list[str], word: Callable[[bytes], bytes], whole: Callable[[str], bytes]):
        self.spaced, self.special, self.whole = spaced, special, whole
        self.words = Recent(word if spaced else lambda latin: b"" if latin[:1].isspace() else word(latin))
        self.pieces = Recent((lambda piece: whole(" " + piece)) if spaced else whole)

    def odd(self, text: str) -> bytes:
        """A text of any letters, by its pieces."""
        first, *parts = cut(text) if self.spaced else ["", *text.split(" ")]
        distinct = list(dict.fromkeys(parts))
        of_piece = dict(zip(distinct, self.pieces.all(distinct)))
        return b"".join([self.whole(first), *map(of_piece.__getitem__, parts)])

    def __call__(self, text: str) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit integers."""
        return next(self.batches(pa.array([text], pa.large_string())))[2].tobytes()

    def batches(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, one past the last, ids, where each text's ids end) for runs of texts of a column without nulls."""
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + RUN, side="right")) - 1)
            if offsets[j] - offsets[i] <= 2 * RUN:
                ids, ends = self.run(texts.slice(i, j - i))
            else:
                ids = np.concatenate([self.run(pa.array([x], pa.large_string()))[0] for x in _slices(texts[i].as_py())])
                ends = np.array([len(ids)])
            yield i, j, ids, ends
            i = j

    def run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's end."""
        odd = self._are_odd(texts)
        plain = texts.filter(pa.array(~odd)) if odd.any() else texts
        ids, ends = self._plain(plain)
        if not odd.any():
            return ids, ends
        own = np.split(ids, ends[:-1]) if len(ends) else []
        fits = iter(own)
        parts = [np.frombuffer(self.odd(texts[t].as_py()), "<u4") if o else next(fits) for t, o in enumerate(odd.tolist())]
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])

    def _are_odd(self, texts: pa.Array) -> np.ndarray:
        offsets = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        bad = _ODD[data]
        bad[:-1] |= (data[:-1] == 0xC2) & (data[1:] < 0xA1)  # control characters, and the space that doesn't break
        places = np.flatnonzero(bad)
        ends = np.searchsorted(places, offsets - offsets[0])
        odd = ends[1:] > ends[:-1]
        for s in self.special:
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        return odd

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        sizes = pc.utf8_length(texts).to_numpy()
        offsets = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw = memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]]
        latin = np.frombuffer(str(raw, "utf-8").encode("latin-1"), np.uint8)
        ends = np.cumsum(sizes)
        if not len(latin):
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        if not self.spaced:
            latin = _LOWER[latin]
        begin = word_begins(latin, (ends - sizes)[sizes > 0], self.spaced)
        edges = np.append(begin, len(latin)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(edges), pa.py_buffer(latin)]).dictionary_encode()
        found = pa.array(self.words.all(_listed(coded.dictionary)), pa.binary()).take(coded.indices)
        upto = np.frombuffer(found.buffers()[1], "<i4")[: len(found) + 1]
        ids = np.frombuffer(found.buffers()[2] or b"", "<u4", upto[-1] // 4)
        return ids, (upto[np.searchsorted(begin, ends)] // 4).astype(np.int64)


class LibraryIds(RunIds):
    """Ids by the tokenizers library."""

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        with open(path, encoding="utf-8") as f:
            special = [t["content"] for t in json.load(f)["added_tokens"]]
        letters, tokenize = byte_letters(), library.model.tokenize
        of_code = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}

        def word(latin: bytes) -> bytes:
            if latin.isalpha():  # its letters stand for themselves
                own = latin.decode()
            elif latin[1:].isalpha() and latin[0] == 32:
                own = "Ġ" + latin[1:].decode()
            else:
                own = latin.decode("latin-1").translate(of_code)
            return array("I", [t.id for t in tokenize(own)]).tobytes()

        super().__init__(spaced, special, word, lambda text: array("I", library.encode(text, add_special_tokens=False).ids).tobytes())


def _listed(values: pa.Array) -> list[bytes]:
    """A binary array as a list, cut out of its buffer (several times as fast as by its scalars)."""
    ends = np.frombuffer(values.buffers()[1], "<i4")[values.offset : values.offset + len(values) + 1].tolist()
    raw = values.buffers()[2].to_pybytes() if ends[-1] else b""
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


def _slices(text: str) -> Iterator[str]:
    """A very long text in slices that begin where a word does."""
    at = 0
    for m in re.finditer(r" (?=\S)", text):
        if m.start() - at >= RUN:
            yield text[at : m.start()]
            at = m.start()
    yield text[at:]


_made: dict[tuple[str, bool], LibraryIds] = {}


def release() -> None:
    """Gives back what this worker remembers, for operators that need the memory themselves."""
    _made.clear()


def library_ids(path: str, spaced: bool) -> LibraryIds:
    if (path, spaced) not in _made:
        _made.clear()
        _made[path, spaced] = LibraryIds(path, spaced)
    return _made[path, spaced]
