"""Words of whole text columns, vectorised over Arrow buffers.

A word is a maximal run of bytes other than space and 0x09-0x0D, the pattern
``[^\\x20\\x09-\\x0D]+``.  The functions here run inside tasks (``mapInArrow``)
on one slice of a record batch at a time, so memory is bounded by the slice
and the longest single text.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 20  # texts handled at once inside a task
_PIECE = 1 << 18  # bytes under one table of powers

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 (base odd), i < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up = np.full(size, base & _MASK, dtype=np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        have = _POWERS[base] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return have


def run_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Polynomial hash of each run ``values[start:end]`` in any number of runs,
    from one prefix sum (arithmetic modulo 2**64)."""
    up, down = _powers(base, len(values) + 1)
    prefix = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * down[start])


@dataclass
class Words:
    """Words of a slice of texts: byte spans in ``data``, 64-bit hashes, and for
    document ``i`` the words ``first[i]:first[i + 1]``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and each text's offsets in them."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    lo, hi = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8)[lo:hi] if hi > lo else np.empty(0, np.uint8)
    return data, offsets - lo


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with at most ``limit`` text bytes (or one row)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(sizes + 16)])
    at = 0
    while at < len(sizes):
        stop = int(np.searchsorted(total, total[at] + limit, side="right")) - 1
        stop = min(max(stop, at + 1), len(sizes))
        yield batch.slice(at, stop - at)
        at = stop


def split_words(col: pa.Array, lower: bool = False) -> Words:
    """Words of every text of ``col``; ``lower`` folds A-Z only."""
    data, offsets = text_bytes(col)
    if lower:
        data = _LOWER[data]
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return Words(data, offsets, none, none, np.empty(0, np.uint64), np.zeros(len(offsets), np.int64))
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)  # a text begins here
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = True, ~word[:-1]
    start = np.flatnonzero(word & (before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = True, ~word[1:]
    end = np.flatnonzero(word & (after | edge[1:])) + 1
    return Words(data, offsets, start, end, _hashes(data, start, end), np.searchsorted(start, offsets).astype(np.int64))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        stop = int(np.searchsorted(end, start[at] + _PIECE, side="right"))
        if stop <= at:  # one word longer than a piece
            out[at] = xxhash.xxh3_64_intdigest(data[start[at] : end[at]].tobytes())
            at += 1
            continue
        lo = start[at]
        piece = data[lo : end[stop - 1]].astype(np.uint64) + np.uint64(1)
        out[at:stop] = run_hash(piece, start[at:stop] - lo, end[at:stop] - lo)
        at = stop
    return mix(out + (end - start).astype(np.uint64))


def window_hash(words: Words, size: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside one document, and the index
    of each run's first word."""
    count = np.maximum(np.diff(words.first) - size + 1, 0)
    at = ragged(words.first[:-1], count)
    return run_hash(words.hash, at, at + size, base), at


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``start[i], start[i] + 1, ...`` with ``count[i]`` entries, end to end."""
    total = int(count.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(start - (ends - count), count)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no column called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def longs(values: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as Spark's signed longs (same bits)."""
    return pa.array(values.view(np.int64))
