"""Stupid-backoff language-model scores from n-gram counts of the whole corpus.

    S(w | context) = count(context w) / count(context)   if count(context w) >= ``LEAST``
                     ``BACKOFF`` * S(w | shorter context)  otherwise
    S(w)           = count(w) / number of words

A document's score is the sum of log S over its words, each with as much
context inside the document as ``order`` allows.

The computation is relational, with rows that carry arrays: documents are
held in blocks of about ``BLOCK_BYTES`` of text; a block's distinct n-grams
(64-bit hashes) with their uses are dealt by ranges of the hash, one row a
(block, hash range); each range adds up its count table and joins it to the
rows, which go back to their block, where the documents are summed.  An
n-gram is one entry a block however often it occurs, so a hot one costs one
entry a block, and ranges of a uniform hash are even.  Their number follows
the number of n-grams, so a task's table stays bounded.

Cases: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; null or blank
texts count nothing and get 0 words, log_score 0 and a null mean; repeated
rows count each time and score alike; a null ``doc_id`` is carried; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .words import mix, slices, split_words

ORDER = 2
BACKOFF = 0.4
LEAST = 2  # uses from which an n-gram of two words or more is taken as seen (the scored text itself is one)
BLOCK_BYTES = 10 << 20
RANGE_ENTRIES = 1 << 21  # entries of a hash range, about


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze(blob: bytes, dtype: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8) if blob else np.empty(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _block(number: int, docs: list, counts: list[np.ndarray], hashes: list[np.ndarray]) -> pa.RecordBatch:
    vocabulary, index, uses = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    order = np.argsort(-uses, kind="stable")  # common words get small numbers
    place = np.empty(len(order), dtype=np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    n = np.concatenate(counts)
    return pa.record_batch(
        [
            pa.array([number], pa.int64()),
            pa.array([docs], pa.list_(pa.int64())),
            pa.array([n], pa.list_(pa.int64())),
            pa.array([squeeze(place[index])], pa.binary()),
            pa.array([squeeze(vocabulary[order])], pa.binary()),
        ],
        ["block", "docs", "n_words", "words", "vocabulary"],
    )


def _blocks(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, docs, counts, hashes, held = TaskContext.get().partitionId() << 32, [], [], [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                words = split_words(part.column("text"), lower=True)
                docs += part.column("doc_id").to_pylist()
                counts.append(np.diff(words.first))
                hashes.append(words.hash)
                held += len(words.data)
                if held >= limit:
                    yield _block(number, docs, counts, hashes)
                    number, docs, counts, hashes, held = number + 1, [], [], [], 0
        if docs:
            yield _block(number, docs, counts, hashes)

    return run


class _Grams:
    """The n-grams of a block: for each order, the row of the gram that starts at
    each word (-1 where the document is too short), hashes and uses by row."""

    def __init__(self, words: np.ndarray, vocabulary: np.ndarray, n_words: np.ndarray, order: int):
        left = np.repeat(np.cumsum(n_words), n_words) - np.arange(len(words))  # words to the document's end
        self.row, self.hash, self.uses = [words.astype(np.int64)], [vocabulary], [np.bincount(words, minlength=len(vocabulary))]
        for n in range(2, order + 1):
            at = np.flatnonzero(left >= n)
            pair = self.row[-1][at].astype(np.uint64) << np.uint64(32) | words[at + n - 1].astype(np.uint64)
            distinct, back, uses = np.unique(pair, return_inverse=True, return_counts=True)
            row = np.full(len(words), -1, dtype=np.int64)
            row[at] = back
            before = self.hash[-1][(distinct >> np.uint64(32)).astype(np.int64)]
            after = vocabulary[(distinct & np.uint64(0xFFFFFFFF)).astype(np.int64)]
            self.row.append(row)
            self.hash.append(mix(before * np.uint64(0x9E3779B97F4A7C15) + after + np.uint64(n)))
            self.uses.append(uses)
        everything = np.concatenate(self.hash)
        self.sorted = np.argsort(everything, kind="stable")
        self.key = everything[self.sorted]
        self.total = np.concatenate(self.uses)[self.sorted]


def _entries(row: dict, order: int) -> _Grams:
    n = np.array(row["n_words"], dtype=np.int64)
    return _Grams(unsqueeze(row["words"], np.uint32), unsqueeze(row["vocabulary"], np.uint64), n, order)


def _deal(order: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                grams = _entries(row, order)
                edges = np.searchsorted(grams.key, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.empty(0, np.int64)
                edges = np.concatenate([[0], edges, [len(grams.key)]])
                parts = np.flatnonzero(np.diff(edges))
                keys, uses = [], []
                for p in parts:
                    some = grams.key[edges[p] : edges[p + 1]]
                    keys.append(squeeze(np.diff(some, prepend=np.uint64(0))))  # sorted: differences
                    uses.append(squeeze(grams.total[edges[p] : edges[p + 1]].astype(np.uint32)))
                yield pa.record_batch(
                    [pa.array(parts, pa.int32()), pa.array([row["block"]] * len(parts), pa.int64()), pa.array(keys, pa.binary()), pa.array(uses, pa.binary())],
                    ["range", "block", "keys", "uses"],
                )

    return run


def _count(table: pa.Table) -> pa.Table:
    """One hash range: its count table, joined to every block's entries."""
    keys = [np.cumsum(unsqueeze(k.as_py(), np.uint64), dtype=np.uint64) for k in table["keys"]]
    uses = [unsqueeze(u.as_py(), np.uint32) for u in table["uses"]]
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(uses)).astype(np.uint64)  # exact below 2**53
    ends = np.cumsum([len(k) for k in keys])
    back = [squeeze(total[at[e - len(k) : e]]) for e, k in zip(ends, keys, strict=True)]
    return pa.table({"range": table["range"], "block": table["block"], "totals": pa.array(back, pa.binary())})


def _score(order: int, corpus: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(block: pa.Table, totals: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        n = np.array(row["n_words"], dtype=np.int64)
        grams = _entries(row, order)
        counts = np.empty(len(grams.key))
        if len(grams.key):
            parts = totals.sort_by("range")
            counts[grams.sorted] = np.concatenate([unsqueeze(t.as_py(), np.uint64) for t in parts["totals"]]).astype(np.float64)
        ends = np.cumsum([len(h) for h in grams.hash])
        count = [counts[e - len(h) : e] for e, h in zip(ends, grams.hash, strict=True)]
        words = len(grams.row[0])
        place = np.arange(words) - np.repeat(np.cumsum(n) - n, n)
        score = np.log(count[0][grams.row[0]] / corpus) if words else np.empty(0)
        value, penalty = score.copy(), np.zeros(words)
        open_ = np.ones(words, dtype=bool)
        for k in range(order, 1, -1):
            at = np.flatnonzero(open_ & (place >= k - 1))  # words with k - 1 words before them
            gram = count[k - 1][grams.row[k - 1][at - k + 1]]
            seen = gram >= LEAST
            hit = at[seen]
            value[hit] = np.log(gram[seen] / count[k - 2][grams.row[k - 2][hit - k + 1]]) + penalty[hit]
            open_[hit] = False
            penalty[at[~seen]] += np.log(BACKOFF)
        value[open_] += penalty[open_]
        sums = np.zeros(len(n))
        full = np.flatnonzero(n)
        if len(full):
            sums[full] = np.add.reduceat(value, (np.cumsum(n) - n)[full])
        mean = pa.array(sums / np.maximum(n, 1), mask=n == 0)
        return pa.table({"doc_id": pa.array(row["docs"], pa.int64()), "n_words": pa.array(n), "log_score": pa.array(sums), "mean_log_score": mean})

    return run


def lm_scores(docs: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES, range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """doc_id, n_words, log_score and its mean by word, for every row, under the
    counts of all rows of ``docs``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with Scratch(docs.sparkSession, "lm_scores") as scratch:
        schema = "block long, docs array<long>, n_words array<long>, words binary, vocabulary binary"
        blocks = scratch.table(texts.mapInArrow(_blocks(block_bytes), schema), "blocks")
        n = F.aggregate("n_words", F.lit(0).cast("long"), lambda a, x: a + x)
        corpus = blocks.agg(F.sum(n)).first()[0] or 0
        bits = max(0, int(order * corpus // range_entries).bit_length())
        dealt = blocks.select("block", "n_words", "words", "vocabulary").mapInArrow(_deal(order, bits), "range int, block long, keys binary, uses binary")
        totals = dealt.groupBy("range").applyInArrow(_count, "range int, block long, totals binary")
        scored = blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(
            _score(order, corpus), "doc_id long, n_words long, log_score double, mean_log_score double"
        )
        return scratch.keep(scored, "result")
