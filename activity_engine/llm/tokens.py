"""Token ids of whole text columns with a public tokenizer file.

The vocabulary (word BPE, lower-casing, white space dropped) never joins text
across white space, and inside a chunk never across a change between
letters, digits and signs.  So a text is cut into such units, equal units of
a slice are encoded once by the ``tokenizers`` library, and the ids of the
text are gathered from a table of units.  Chunks with anything unusual
(bytes beyond the Latin-1 letters, control characters, apostrophes, the
start of a special token) are handed to the library whole.  The table of
known units has a fixed size; it saves work and never changes a result.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .words import _LOWER, _hashes, ragged, split_words

SLOTS = 1 << 21  # units remembered by one task process at most
POOL = 1 << 24  # token ids remembered at most

_SIGN, _LETTER, _DIGIT, _ODD = 0, 1, 2, 3
_CLASS = np.full(256, _ODD, dtype=np.int8)
_CLASS[33:127] = _SIGN
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _LETTER
_CLASS[97:123] = _LETTER
_CLASS[39] = _ODD
# second bytes of the two-byte letters U+00C0 to U+00FF but the signs at D7 and F7
_LATIN = np.zeros(256, dtype=bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False


class Encoder:
    """Ids of many texts; ``specials`` says whether the strings of special
    tokens in a text stand for those tokens (the library's default)."""

    def __init__(self, path: str, specials: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not specials
        self._forget()

    def _forget(self) -> None:
        self.key = np.zeros(SLOTS, dtype=np.uint64)
        self.start = np.zeros(SLOTS, dtype=np.int64)
        self.count = np.zeros(SLOTS, dtype=np.int32)
        self.pool = np.empty(1 << 16, dtype=np.int32)
        self.used = 0

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids of each (null: none)."""
        words = split_words(col)
        if not len(words.hash):
            return np.empty(0, np.int32), np.zeros(len(words.first) - 1, np.int64)
        data = words.data
        kind = _CLASS[data]
        latin = np.zeros(len(data) + 1, dtype=bool)
        latin[1:-1] = (data[:-1] == 0xC3) & _LATIN[data[1:]]
        kind[latin[:-1] | latin[1:]] = _LETTER
        odd = np.concatenate([[0], np.cumsum(kind == _ODD)])
        special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))  # "<|"
        whole = odd[words.end] > odd[words.start]
        whole[np.searchsorted(words.start, special, side="right") - 1] = True
        inside = np.zeros(len(data) + 1, dtype=np.int8)  # bytes of chunks that are handed over whole
        inside[words.start[whole]] = 1
        inside[words.end[whole]] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
        data = np.where(inside, data, _LOWER[data])

        first = np.zeros(len(data), dtype=bool)
        first[1:] = ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)) & ~inside[1:]
        # inside words only: a running count that is 1 from a start to its end
        begun = np.zeros(len(data) + 1, dtype=np.int32)
        begun[words.start] += 1
        begun[words.end] -= 1
        first &= np.cumsum(begun[:-1]) > 0
        first[words.start] = True
        start = np.flatnonzero(first)
        word = np.searchsorted(words.start, start, side="right") - 1
        end = words.end[word]
        same = word[1:] == word[:-1]
        end[:-1][same] = start[1:][same]
        ids, count = self._units(data, start, end, whole[word])
        per_word = np.bincount(word, weights=count, minlength=len(words.hash)).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(per_word)])
        return ids, total[words.first[1:]] - total[words.first[:-1]]

    def _units(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = _hashes(data, start, end) * np.uint64(2) + whole.astype(np.uint64)
        key[key == 0] = 1
        one = (key >> np.uint64(5)).astype(np.int64) & (SLOTS - 1)
        two = (key >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)
        slot = np.where(self.key[one] == key, one, two)
        miss = np.flatnonzero(self.key[slot] != key)
        at, count = self.start[slot], self.count[slot].astype(np.int64)
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            example = np.empty(len(new), dtype=np.int64)
            example[back] = miss
            lists = self._library([data[a:b].tobytes() for a, b in zip(start[example], end[example], strict=True)], whole[example])
            size = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
            flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(size.sum()))
            place = self._remember(flat)
            begin = place + np.cumsum(size) - size
            at[miss], count[miss] = begin[back], size[back]
            spot = np.where(self.key[one[example]] == 0, one[example], two[example])
            self.key[spot], self.start[spot], self.count[spot] = new, begin, size
        ids = self.pool[ragged(at, count)]
        if self.used > POOL:
            self._forget()
        return ids, count

    def _remember(self, flat: np.ndarray) -> int:
        place = self.used
        if place + len(flat) > len(self.pool):
            wider = np.empty(2 * (place + len(flat)), dtype=np.int32)
            wider[:place] = self.pool[:place]
            self.pool = wider
        self.pool[place : place + len(flat)] = flat
        self.used += len(flat)
        return place

    def _library(self, units: list[bytes], whole: np.ndarray) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(units)
        rest = []
        model = self.tokenizer.model
        for i, unit in enumerate(units):
            if not whole[i] and unit.isascii() and unit.isalpha():
                out[i] = [t.id for t in model.tokenize(unit.decode())]  # lower-case letters: one piece as it is
            else:
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([units[i].decode() for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, specials: bool = True) -> Encoder:
    """The encoder of this task process (units stay known between tasks)."""
    if (path, specials) not in _ENCODERS:
        _ENCODERS[path, specials] = Encoder(path, specials)
    return _ENCODERS[path, specials]


def shards(
    batches: Iterator[pa.RecordBatch], path: str, end_id: int, limit: int, specials: bool, slices: Callable[[pa.RecordBatch, str], Iterator[pa.RecordBatch]]
) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """(ids, ids of each document, doc_ids) of consecutive documents, ``end_id``
    after each, cut after the document that reaches ``limit`` ids."""
    enc = encoder(path, specials)
    held, counts, docs, n = [], [], [], 0
    for batch in batches:
        for part in slices(batch, "text"):
            ids, count = enc.encode(part.column("text"))
            ends = np.cumsum(count)
            count = count + 1
            ids = np.insert(ids, ends, end_id)
            names = part.column("doc_id").to_pylist()
            total = np.concatenate([[0], np.cumsum(count)])
            at = 0
            while at < len(count):
                stop = min(len(count), int(np.searchsorted(total, total[at] + max(1, limit - n))))
                stop = max(stop, at + 1)
                held.append(ids[total[at] : total[stop]])
                counts.append(count[at:stop])
                docs += names[at:stop]
                n += int(total[stop] - total[at])
                at = stop
                if n >= limit:
                    yield np.concatenate(held), np.concatenate(counts), docs
                    held, counts, docs, n = [], [], [], 0
    if docs:
        yield np.concatenate(held), np.concatenate(counts), docs
