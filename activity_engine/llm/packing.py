"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted at once.  Pieces (a document longer
than the largest length is split) are placed longest first into the open bin
with the least room that still fits.  Where none fits, a new bin is opened
at the size of least cost per token, judged together over all sizes: each
size is filled on trial with the pieces still to come, and its cost is its
length plus a fixed overhead.  When all pieces are placed, every bin is
shrunk to the smallest permitted length that holds its contents.

The packing runs over each partition's rows in groups of ``GROUP`` pieces,
so there is no shuffle, no key that could be hot, and memory is bounded; a
group's last bins are the only ones a larger group would fill better.

Cases: null or blank texts have length 0 and get one row without a bin;
repeated rows and equal ids are packed one by one; a null ``doc_id`` is
carried as null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 16  # cost of a sequence besides its length
GROUP = 1 << 16
SCHEMA = "doc_id long, piece int, start long, length long, bin_id long, capacity int, offset int"


def word_count(text: str = "text") -> Column:
    """Length of a document in words (0 for null)."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


class _Room:
    """Open bins by the room left in them."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.bins: dict[int, list[int]] = defaultdict(list)

    def put(self, room: int, bin_: int) -> None:
        if room:
            if not self.bins[room]:
                insort(self.sizes, room)
            self.bins[room].append(bin_)

    def take(self, length: int) -> tuple[int, int] | None:
        at = bisect_left(self.sizes, length)
        if at == len(self.sizes):
            return None
        room = self.sizes[at]
        bin_ = self.bins[room].pop()
        if not self.bins[room]:
            del self.sizes[at]
        return room, bin_


def _filled(room: int, lengths: list[int], left: Counter) -> int:
    """Tokens that the largest pieces still to come would put into ``room``."""
    used, at, taken = 0, len(lengths), Counter()
    while room and (at := bisect_right(lengths, room, 0, at)):
        length = lengths[at - 1]
        fit = min(left[length] - taken[length], room // length)
        taken[length] += fit
        used, room, at = used + fit * length, room - fit * length, at - 1
    return used


def best_fit(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, its offset in the bin, capacity of each bin); every
    length is between 1 and the largest capacity."""
    sizes = sorted(capacities)
    left = Counter(lengths)
    rising = sorted(left)
    room, bins, offsets = _Room(), [0] * len(lengths), [0] * len(lengths)
    used: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        length = lengths[i]
        left[length] -= 1
        if not left[length]:
            rising.pop()  # the longest still to come
        found = room.take(length)
        if found is None:
            capacity = min(
                (c for c in sizes if c >= length),
                key=lambda c: ((c + overhead) / (length + _filled(c - length, rising, left)), c),
            )
            found = (capacity, len(used))
            used.append(0)
        free, bin_ = found
        bins[i], offsets[i] = bin_, used[bin_]
        used[bin_] += length
        room.put(free - length, bin_)
    return bins, offsets, [sizes[bisect_left(sizes, u)] for u in used]


def _pack(capacities: tuple[int, ...], overhead: int, group: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    largest = max(capacities)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        """Rows (valid, doc_id, piece, start, length) of at most ``group`` pieces at a time."""
        for batch in batches:
            ids = batch.column("doc_id")
            valid = ~np.asarray(ids.is_null())
            doc = ids.fill_null(0).to_numpy()
            n = batch.column("length").to_numpy()
            parts = np.maximum(-(-n // largest), 1)
            ends = np.cumsum(parts)
            for lo in range(0, int(ends[-1]) if len(ends) else 0, group):
                at = np.arange(lo, min(lo + group, int(ends[-1])))
                row = np.searchsorted(ends, at, side="right")
                piece = at - (ends[row] - parts[row])
                start = piece * largest
                yield valid[row], doc[row], piece, start, np.minimum(n[row] - start, largest)

    def packed(rows: list[tuple[np.ndarray, ...]], base: int) -> tuple[pa.RecordBatch, int]:
        valid, doc, piece, start, length = (np.concatenate(x) for x in zip(*rows, strict=True))
        some = np.flatnonzero(length > 0)
        bins, offsets, sizes = best_fit(length[some].tolist(), capacities, overhead)
        bin_, size, offset = (np.zeros(len(doc), np.int64) for _ in range(3))
        bin_[some], offset[some] = bins, offsets
        size[some] = np.array(sizes, dtype=np.int64)[bins] if len(some) else 0
        none = length == 0
        batch = pa.record_batch(
            [
                pa.array(doc, mask=~valid),
                pa.array(piece.astype(np.int32)),
                pa.array(start.astype(np.int64)),
                pa.array(length.astype(np.int64)),
                pa.array(base + bin_, mask=none),
                pa.array(size.astype(np.int32), mask=none),
                pa.array(offset.astype(np.int32), mask=none),
            ],
            ["doc_id", "piece", "start", "length", "bin_id", "capacity", "offset"],
        )
        return batch, base + len(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, rows, held = TaskContext.get().partitionId() << 33, [], 0
        for part in pieces(batches):
            rows.append(part)
            held += len(part[1])
            if held >= group:
                batch, base = packed(rows, base)
                yield batch
                rows, held = [], 0
        if rows:
            yield packed(rows, base)[0]

    return run


def pack(
    docs: DataFrame,
    length: Column | None = None,
    capacities: Sequence[int] = CAPACITIES,
    overhead: int = OVERHEAD,
    group: int = GROUP,
) -> DataFrame:
    """One row for each piece: the words ``[start, start + length)`` of ``doc_id``
    lie at ``offset`` of sequence ``bin_id``, which is ``capacity`` long.

    ``length`` is the document's length (by default its words)."""
    lengths = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.coalesce((word_count() if length is None else length).cast("long"), F.lit(0)), F.lit(0)).alias("length"))
    return lengths.mapInArrow(_pack(tuple(capacities), overhead, group), SCHEMA)
