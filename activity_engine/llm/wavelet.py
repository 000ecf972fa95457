"""Token-id files as wavelet matrices.

Documents are encoded in ascending ``doc_id`` order, an end id after each,
and written in shards of consecutive documents.  A shard file holds one
wavelet matrix: one bit-plane for each bit of the ids, in chunks compressed one
by one, a small header, and the rank before every chunk.  They give access to
a token, counts of an id up to a place, and the place of its n-th occurrence,
from the compressed file: a lookup reads and inflates a chunk a plane.
``count_tokens`` and ``locate_tokens`` do so over all files as Spark jobs.

Rows are dealt by ranges of ``doc_id`` and sorted inside a partition; a shard
closes at ``SHARD`` ids, so memory in a task is bounded by a shard and the
longest document.  A document's global start is a running sum over the
shards' totals.

Cases: null or blank texts have the end id alone; a null ``doc_id`` comes
first; equal ids stay next to each other, in the order of their texts; an
empty table writes no files; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import files
from .tokens import shards
from .words import slices

SHARD = 1 << 21  # ids of a file, more only where one document is longer
CHUNK = 1 << 13  # bytes of a plane compressed together, with the rank before them
TASK_IDS = 1 << 24  # ids that one task reads back, about
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.int64)


class WaveletMatrix:
    """A sequence of ids under ``2**bits`` as bit-planes with rank and select.

    The file holds each plane in chunks compressed one by one, with the place of
    every chunk and the ones before it, so a lookup inflates a chunk a plane."""

    def __init__(self, length: int, zeros: list[int], index: list[np.ndarray], meta: dict, source: Callable[[int, int], bytes]):
        self.length, self.zeros, self.meta = length, zeros, meta
        self._index, self._source = index, source  # a plane's index: place in the file and ones before, per chunk and at the end
        self._held: dict[tuple[int, int], np.ndarray] = {}

    @classmethod
    def build(cls, ids: np.ndarray, bits: int, meta: dict | None = None) -> WaveletMatrix:
        if len(ids) and (int(ids.max()) >> bits or int(ids.min()) < 0):
            raise ValueError(f"an id needs more than {bits} bits")
        values = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        squeeze = zstandard.ZstdCompressor(level=1)
        zeros, index, packed, at = [], [], [], 0
        for level in range(bits - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            plane = np.packbits(bit)
            places, ones = [at], [0]
            for begin in range(0, len(plane), CHUNK):
                chunk = plane[begin : begin + CHUNK]
                packed.append(squeeze.compress(chunk.tobytes()))
                at += len(packed[-1])
                places.append(at)
                ones.append(ones[-1] + int(_ONES[chunk].sum()))
            index.append(np.array([places, ones], dtype=np.int64))
            low = values[~bit]
            zeros.append(len(low))
            values = np.concatenate([low, values[bit]])
        body = b"".join(packed)
        return cls(len(ids), zeros, index, meta or {}, lambda offset, n: body[offset : offset + n])

    def to_bytes(self) -> bytes:
        head = json.dumps({"length": self.length, "zeros": self.zeros, "chunks": [i.shape[1] for i in self._index], "meta": self.meta}).encode()
        index = b"".join(i.astype("<i8").tobytes() for i in self._index)
        return b"WVMY" + len(head).to_bytes(8, "little") + head + index + self._source(0, max((int(i[0, -1]) for i in self._index), default=0))

    @classmethod
    def _from(cls, source: Callable[[int, int], bytes]) -> WaveletMatrix:
        start = source(0, 12)
        if start[:4] != b"WVMY":
            raise ValueError("not a wavelet matrix file")
        at = 12 + int.from_bytes(start[4:], "little")
        head = json.loads(source(12, at - 12))
        flat = np.frombuffer(source(at, 16 * sum(head["chunks"])), "<i8")
        ends = np.cumsum([0, *(2 * n for n in head["chunks"])])
        index = [flat[a:b].reshape(2, -1) for a, b in zip(ends, ends[1:])]
        body = at + 8 * len(flat)
        return cls(head["length"], head["zeros"], index, head["meta"], lambda offset, n: source(body + offset, n))

    @classmethod
    def from_bytes(cls, blob: bytes) -> WaveletMatrix:
        return cls._from(lambda offset, n: blob[offset : offset + n])

    @classmethod
    def open(cls, path: str) -> WaveletMatrix:
        """The matrix of a file, of which only what lookups need is read."""
        return cls._from(lambda offset, n: files.read(path, offset, n) if n else b"")

    def _bytes(self, level: int) -> np.ndarray:
        places = self._index[level][0]
        body, begin = self._source(int(places[0]), int(places[-1] - places[0])), int(places[0])
        inflate = zstandard.ZstdDecompressor()
        return np.frombuffer(b"".join(inflate.decompress(body[a - begin : b - begin]) for a, b in zip(places[:-1].tolist(), places[1:].tolist())), np.uint8)

    def _chunk(self, level: int, number: int) -> np.ndarray:
        if (level, number) not in self._held:
            if len(self._held) >= 256:  # 2 MB of chunks
                self._held.clear()
            places = self._index[level][0]
            blob = self._source(int(places[number]), int(places[number + 1] - places[number]))
            self._held[level, number] = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
        return self._held[level, number]

    def _rank1(self, level: int, place: int) -> int:
        number, rest = divmod(place, 8 * CHUNK)
        n = int(self._index[level][1, number])
        if rest:
            chunk = self._chunk(level, number)
            n += int(_ONES[chunk[: rest // 8]].sum())
            if rest % 8:
                n += (int(chunk[rest // 8]) >> (8 - rest % 8)).bit_count()
        return n

    def _select(self, level: int, bit: int, nth: int) -> int:
        """Place of the nth (from 0) such bit of a plane: its chunk by the stored
        ranks, then the bit inside."""
        ones = self._index[level][1]
        before = ones if bit else np.minimum(np.arange(len(ones)) * 8 * CHUNK, self.length) - ones
        number = int(np.searchsorted(before, nth, side="right")) - 1
        bits = np.unpackbits(self._chunk(level, number), count=min(8 * CHUNK, self.length - number * 8 * CHUNK))
        return number * 8 * CHUNK + int(np.flatnonzero(bits == bit)[nth - int(before[number])])

    def access(self, place: int) -> int:
        """The id at a place."""
        if not 0 <= place < self.length:
            raise IndexError(place)
        value = 0
        for level, zeros in enumerate(self.zeros):
            ones = self._rank1(level, place)
            bit = self._rank1(level, place + 1) - ones
            place = zeros + ones if bit else place - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, place: int) -> tuple[int, int]:
        """Where the token's occurrences before ``place`` lie after the last plane."""
        lo, hi, bits = 0, place, len(self.zeros)
        if token < 0 or token >> bits:
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (zeros + a, zeros + b) if token >> (bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, place: int | None = None) -> int:
        """Occurrences of an id before ``place`` (by default, in all)."""
        lo, hi = self._range(token, self.length if place is None else place)
        return hi - lo

    def occurrence(self, token: int, nth: int) -> int:
        """Place of the nth (from 0) occurrence of an id."""
        lo, hi = self._range(token, self.length)
        if not 0 <= nth < hi - lo:
            raise IndexError(nth)
        place, bits = lo + nth, len(self.zeros)
        for level in range(bits - 1, -1, -1):
            bit = token >> (bits - 1 - level) & 1
            place = self._select(level, bit, place - self.zeros[level] if bit else place)
        return place

    def decode(self) -> np.ndarray:
        """The whole sequence, planes merged from the last to the first."""
        values = np.zeros(self.length, dtype=np.uint32 if len(self.zeros) > 16 else np.uint16)
        for level in range(len(self.zeros) - 1, -1, -1):
            bit = np.unpackbits(self._bytes(level), count=self.length).astype(bool)
            above = np.empty_like(values)
            above[~bit] = values[: self.zeros[level]]
            above[bit] = values[self.zeros[level] :] | values.dtype.type(1 << (len(self.zeros) - 1 - level))
            values = above
        return values


def _write(folder: str, path: str, end_id: int, limit: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, (ids, counts, docs) in enumerate(shards(batches, path, end_id, limit, True, slices)):
            name = f"{folder}/{part:06d}-{number:06d}.wvm"
            files.write(name, WaveletMatrix.build(ids, bits, {"doc_id": docs, "tokens": counts.tolist()}).to_bytes())
            yield pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([name]), pa.array([len(ids)], pa.int64())],
                ["part", "number", "path", "tokens"],
            )

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, bits: int = 16, shard: int = SHARD) -> DataFrame:
    """Write shard files under ``folder``; a row for each: part, number (their
    order is that of ``doc_id``), path, tokens.  Runs when the frame does."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranges = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ranges.mapInArrow(_write(folder, tokenizer, end_id, shard, bits), "part int, number int, path string, tokens long")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
            matrix = WaveletMatrix.from_bytes(files.read(name))
            counts = np.array(matrix.meta["tokens"], dtype=np.int64)
            ends = np.cumsum(counts)
            flat = memoryview(matrix.decode().astype("<u4")).cast("B")
            crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(ends - counts, ends, strict=True)]
            yield pa.record_batch(
                [pa.array(matrix.meta["doc_id"], pa.int64()), pa.array(before + ends - counts), pa.array(counts), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def _placed(manifest: DataFrame) -> DataFrame:
    """path, tokens, and the ids before each file.

    The running sum is over one row a file, parts first, then files in a part."""
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("n"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    placed = manifest.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(parts, "part")
    return placed.select("path", "tokens", (F.col("base") + F.col("inside")).alias("before"))


def _dealt(placed: DataFrame, task_ids: int) -> DataFrame:
    """The files dealt to tasks of about ``task_ids`` ids.  The number is given, as
    rows of a few bytes would else be put together into one task."""
    total = placed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("ids")).first()
    tasks = max(-(-total.ids // task_ids), placed.sparkSession.sparkContext.defaultParallelism)
    return placed.repartition(max(1, min(total.n, tasks)))


def read_digest(manifest: DataFrame, task_ids: int = TASK_IDS) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    each = _dealt(_placed(manifest), task_ids).select("path", "before")
    return each.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _look_up(tokens: tuple[int, ...], places: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                matrix = WaveletMatrix.open(path)
                ends = np.cumsum(matrix.meta["tokens"])
                for token in tokens:
                    n = matrix.count(token)
                    if not places:
                        yield pa.record_batch([pa.array([token], pa.int64()), pa.array([n], pa.int64())], ["token", "n"])
                        continue
                    for first in range(0, n, 4096):
                        at = np.array([matrix.occurrence(token, i) for i in range(first, min(n, first + 4096))], dtype=np.int64)
                        doc = np.searchsorted(ends, at, side="right")
                        ids = pa.array(matrix.meta["doc_id"], pa.int64()).take(pa.array(doc))
                        inside = at - np.concatenate([[0], ends])[doc]
                        yield pa.record_batch([pa.array(np.full(len(at), token)), ids, pa.array(inside), pa.array(at + before)], ["token", "doc_id", "place", "position"])

    return run


def count_tokens(manifest: DataFrame, tokens: Sequence[int], task_ids: int = TASK_IDS) -> DataFrame:
    """(token, n): occurrences over all files, by rank alone (a few chunks a file are
    read, whatever its size)."""
    found = _dealt(_placed(manifest), task_ids).mapInArrow(_look_up(tuple(dict.fromkeys(tokens)), False), "token long, n long")
    return found.groupBy("token").agg(F.sum("n").alias("n"))


def locate_tokens(manifest: DataFrame, tokens: Sequence[int], task_ids: int = TASK_IDS) -> DataFrame:
    """(token, doc_id, place, position) of every occurrence, by select: the place in
    the document and the position among the ids of all documents."""
    return _dealt(_placed(manifest), task_ids).mapInArrow(_look_up(tuple(dict.fromkeys(tokens)), True), "token long, doc_id long, place long, position long")
