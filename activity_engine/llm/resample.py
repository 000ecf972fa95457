"""Importance resampling of documents towards a target distribution.

Texts are bags of hashed word runs (one to two words, in buckets).  A
bucket's gain is the logarithm of its rate in the target texts over its rate
in the raw texts, a document's weight is the mean gain of its features, and
the documents with the largest weight plus Gumbel noise of their own id are
drawn: a sample without replacement in proportion to the weights.

Method.  A task takes texts slice by slice.  All n-gram occurrences of a
slice are byte spans of one buffer; their xxhash64 is computed over the spans
of equal length together, and an open-addressed NumPy table interns them:
occurrences probe from the slot their key names, an empty slot is claimed,
and a taken one is theirs only if its key and its bytes, compared in full,
are the same.  A slot stores the n-gram's bucket (the checksum is made once
for each distinct n-gram) and its count; an occurrence keeps the number of
its slot, through which it gathers its gain.  The counts of all tasks are
summed by bucket (a vector of ``BUCKETS`` numbers a task at most), and the
gains, one number a bucket, go to the second pass over the texts.

The draw needs a place in the order of all scores: rows are written sorted by
ranges, counted by range, and the running total of the ranges is added to a
row's place in its range.

Cases: a null text counts as empty; a document without words has weight 0; a
null ``doc_id`` takes the noise of the empty string; repeated rows are drawn
row by row, ties going to the smaller ``doc_id`` (null first); without target
texts, or without documents, the formula still holds; an empty table of
documents gives no rows; other columns of both inputs are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch
from .words import _LOWER, ragged, slices, text_bytes

BUCKETS = 10_000
SLICE_BYTES = 1 << 20  # text under one table
_SHORT = 32  # shorter n-grams are hashed together by length

_WORD = np.zeros(256, dtype=bool)
_WORD[0x30:0x3A] = True
_WORD[0x61:0x7B] = True
_WORD[0x80:] = True

# The primes of xxhash64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


# ---------------------------------------------------------------- n-grams


class Grams:
    """Occurrences of word runs of a column of texts: spans ``start``, ``length``
    of ``data`` (lower-cased, one space between words) and the row of each."""

    def __init__(self, col: pa.Array, longest: int):
        raw, offsets = text_bytes(col)
        raw = _LOWER[raw]
        self.rows = len(offsets) - 1
        word = _WORD[raw]
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[offsets] = True
        before = np.concatenate([[False], word])[: len(raw)] & ~edge[:-1]  # the byte before, of the same text
        after = np.concatenate([word, [False]])[1 : len(raw) + 1] & ~edge[1:]
        begin, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        keep = word | before  # words and the first byte after each
        at = np.cumsum(keep) - 1
        packed = np.where(word, raw, np.uint8(32))[keep]
        self.data = np.concatenate([packed, np.zeros(8, np.uint8)])
        begin, end = at[begin], (at[end - 1] + 1 if len(end) else end)
        first = np.searchsorted(np.flatnonzero(word & ~before), offsets)
        self.words = np.diff(first)
        row = np.repeat(np.arange(self.rows), self.words)
        starts, lengths, rows = [], [], []
        for n in range(1, longest + 1):
            count = np.maximum(self.words - n + 1, 0)
            lead = ragged(first[:-1], count)
            starts.append(begin[lead])
            lengths.append(end[lead + n - 1] - begin[lead])
            rows.append(row[lead])
        self.start, self.length, self.row = (np.concatenate(x).astype(np.int64) for x in (starts, lengths, rows))
        self.features = np.bincount(self.row, minlength=self.rows)
        # the eight bytes at every place of the data, as one number
        self.eight = np.ndarray(max(len(self.data) - 7, 0), dtype="<u8", buffer=self.data.data, strides=(1,)) if len(self.data) > 7 else np.zeros(0, "<u8")

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.start[i] + self.length[i]].tobytes()


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def gram_keys(g: Grams) -> np.ndarray:
    """xxhash64 (seed 0) of every occurrence, spans of one length at a time."""
    out = np.empty(len(g.start), dtype=np.uint64)
    order = np.argsort(np.minimum(g.length, _SHORT).astype(np.uint8), kind="stable")
    bounds = np.searchsorted(g.length[order].clip(max=_SHORT), np.arange(_SHORT + 1))
    for size in range(1, _SHORT):
        rows = order[bounds[size] : bounds[size + 1]]
        if not len(rows):
            continue
        at = g.start[rows]
        h = np.full(len(rows), _P5 + np.uint64(size))
        for k in range(size // 8):
            h ^= _turn(g.eight[at + 8 * k] * _P2, 31) * _P1
            h = _turn(h, 27) * _P1 + _P4
        done = size // 8 * 8
        if size - done >= 4:
            h ^= (g.eight[at + done] & np.uint64(0xFFFFFFFF)) * _P1
            h = _turn(h, 23) * _P2 + _P3
            done += 4
        for k in range(done, size):
            h ^= g.data[at + k].astype(np.uint64) * _P5
            h = _turn(h, 11) * _P1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        out[rows] = h ^ (h >> np.uint64(32))
    for i in order[bounds[_SHORT] :]:
        out[i] = xxhash.xxh64_intdigest(g.text(i))
    return out


def _same_bytes(g: Grams, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Have the occurrences ``a[i]`` and ``b[i]`` equal bytes?"""
    same = g.length[a] == g.length[b]
    left = np.flatnonzero(same & (a != b))
    at = 0
    while len(left):
        x, y = a[left], b[left]
        rest = g.length[x] - at
        mask = np.where(rest >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (8 * np.minimum(rest, 7)).astype(np.uint64)) - np.uint64(1))
        equal = ((g.eight[g.start[x] + at] ^ g.eight[g.start[y] + at]) & mask) == 0
        same[left[~equal]] = False
        at += 8
        left = left[equal & (rest > 8)]
    return same


def _crc_steps() -> np.ndarray:
    """Byte steps of CRC-32, from its reversed polynomial."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = (step >> np.uint32(1)) ^ np.where(step & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return step


_CRC = _crc_steps()


def gram_checksums(g: Grams, which: np.ndarray) -> np.ndarray:
    """CRC-32 of the occurrences ``which``, byte by byte over all of them; those
    that are used up drop out."""
    order = which[np.argsort(-g.length[which], kind="stable")]  # the longest first
    start, length = g.start[order], g.length[order]
    crc = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    many = int(np.searchsorted(-length, -_SHORT, side="left"))  # longer ones are left to the library
    still = np.searchsorted(-length, -np.arange(_SHORT + 1), side="left")  # so many are longer than each length
    for at in range(_SHORT):
        live = slice(many, still[at])
        byte = g.data[start[live] + at]
        crc[live] = _CRC[(crc[live] ^ byte) & np.uint32(255)] ^ (crc[live] >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    crc[:many] = [zlib.crc32(g.text(i)) for i in order[:many]]
    out = np.empty(len(order), dtype=np.uint32)
    out[np.argsort(-g.length[which], kind="stable")] = crc
    return out


class Table:
    """Open-addressed table of a slice's distinct n-grams: for each slot the
    bucket and the count, for each occurrence its slot."""

    def __init__(self, g: Grams, buckets: int, keys: np.ndarray | None = None):
        keys = gram_keys(g) if keys is None else keys
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        owner = np.full(size, -1, dtype=np.int32)  # the occurrence that claimed the slot
        self.slot = np.empty(len(keys), dtype=np.int32)
        at = (keys & np.uint64(size - 1)).astype(np.int32)
        waiting, key = np.arange(len(keys), dtype=np.int32), keys
        while len(waiting):
            holder = owner[at]
            free = np.flatnonzero(holder < 0)
            owner[at[free]] = waiting[free]  # of several, one claims it
            holder[free] = owner[at[free]]
            mine = keys[holder] == key
            other = np.flatnonzero(mine & (holder != waiting))
            mine[other] = _same_bytes(g, holder[other], waiting[other])
            self.slot[waiting[mine]] = at[mine]
            left = ~mine
            waiting, key = waiting[left], key[left]
            at = (at[left] + 1) & (size - 1)
        taken = np.flatnonzero(owner >= 0)
        self.bucket = np.zeros(size, dtype=np.int32)
        self.bucket[taken] = gram_checksums(g, owner[taken]) % np.uint32(buckets)
        self.count = np.bincount(self.slot, minlength=size)


# ---------------------------------------------------------------- passes


def _bucket_counter(longest: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                table = Table(Grams(part["text"], longest), buckets)
                used = np.flatnonzero(table.count)
                np.add.at(total, table.bucket[used], table.count[used])
        bucket = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(total[bucket])], ["bucket", "n"])

    return count


def bucket_counts(texts: DataFrame, longest: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of the features of all texts, buckets without any left out."""
    counted = texts.select("text").mapInArrow(_bucket_counter(longest, buckets), "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln(target rate / raw rate)) of every bucket, counts raised by
    one each.  What comes to the driver is one number a bucket."""
    sides = raw.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(
        target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    )
    rows = sides.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).toArrow()
    s, t = np.zeros(buckets), np.zeros(buckets)
    s[rows["bucket"].to_numpy()] = rows["s"].to_numpy()
    t[rows["bucket"].to_numpy()] = rows["t"].to_numpy()
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weigher(gains: np.ndarray, longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                g = Grams(part["text"], longest)
                table = Table(g, len(gains))
                gained = gains[table.bucket][table.slot]
                total = np.zeros(g.rows, dtype=np.int64)
                np.add.at(total, g.row, gained)
                weight = np.where(g.features > 0, total // np.maximum(g.features, 1), 0)
                columns = [part["doc_id"].cast(pa.int64()), *(pa.array(x.astype(np.int64)) for x in (g.words, g.features, weight))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    return weigh


def gumbel(key: Column, seed: int) -> Column:
    """floor(1000 times a Gumbel variate) of a key, from the first 32 bits of a digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, longest: int = 2, buckets: int = BUCKETS, seed: int = 7
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; ``rank`` counts
    from 1 over the ``percent`` of those with ``min_words`` that are drawn."""
    docs, target = docs.select("doc_id", "text"), target.select("text")
    with Scratch(docs.sparkSession, "resample") as scratch:
        gains = bucket_gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets), buckets)
        weighed = docs.mapInArrow(_weigher(gains, longest), "doc_id long, n_words long, n_features long, weight long")
        scored = scratch.table(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scored")
        able = F.col("n_words") >= min_words
        ordered = scored.filter(able).repartitionByRange(F.col("score").desc(), F.col("doc_id"))
        placed = ordered.sortWithinPartitions(F.col("score").desc(), F.col("doc_id")).withColumn("at", F.monotonically_increasing_id())
        placed = scratch.table(placed, "placed")
        part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
        # one row a range; their number is that of the shuffle's partitions
        ranges = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        ranges = ranges.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        able_rows = placed.withColumn("part", part).join(ranges, "part", "left")
        drawn = scored.filter(able).count() * percent // 100
        rank = F.col("before") + place + 1
        columns = ["doc_id", "n_features", "weight", "score"]
        out = able_rows.select(*columns, F.when(rank <= drawn, rank).alias("rank")).unionByName(
            scored.filter(~able).select(*columns, F.lit(None).cast("long").alias("rank"))
        )
        return scratch.keep(out, "result")
