"""MinHash near-duplicates: universal hash minima, banding, verification, components.

Method.  Each document's set of distinct word shingles gets ``MINIMA``
minima under random universal hashes (one pass over the text).  Documents
with equal sets form one class and only its smallest id goes on.  The
signature is cut into ``BANDS``; documents that share a band are candidates.
Candidates whose signatures agree too little are dropped (bound 4.5 standard
deviations below the threshold), the others are confirmed on their full sets,
and the confirmed links go to alternating large-star and small-star.

No bucket is expanded into pairs.  A bucket's members are tied to its
smallest id, and the components of these ties are families: every pair that
shares a band lies in one family.  A family's members meet in numpy, block by
block, and are confirmed on the full sets inside the task; members already
connected need no comparison, so no link that could change a component is
left out, and what comes out is at most one link a document and block.
With 28 bands of 4 minima a pair at similarity 0.8 shares no band with
probability 4e-7.

Cases: null or blank text and texts without words have ``n_shingles`` 0, link
with nothing and stay; a document with fewer words than a shingle has one
shingle, its whole sequence; rows with a null ``doc_id`` link with nothing,
have a null component and stay; rows that share a ``doc_id`` are one node;
repeated rows are all returned; an empty table gives no rows; other columns
of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from . import bitmap
from .components import components
from .words import fresh_name, mix, ragged, run_hash, slices, split_words

MINIMA, BANDS = 112, 28
ROWS = MINIMA // BANDS
BLOCK = 512  # members of a family that are compared in one task at once
BLOCK_BYTES = 16 << 20  # and bytes of their sets

_RANDOM = np.random.default_rng(6)
_MULTIPLY = _RANDOM.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RANDOM.integers(0, 1 << 63, MINIMA, dtype=np.uint64)


def shingle_sets(col: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text, its sorted distinct shingle hashes (A-Z lower-cased)."""
    words = split_words(col, lower=True)
    n = np.diff(words.first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    at = ragged(words.first[:-1], count)
    grams = run_hash(words.hash, at, at + np.repeat(np.minimum(n, size), count))
    ends = np.cumsum(count)
    for lo, hi in zip(ends - count, ends, strict=True):
        yield np.unique(grams[lo:hi])


def signature(grams: np.ndarray) -> np.ndarray:
    """Smallest value of each universal hash over a non-empty set."""
    low = np.full(MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(grams), 4096):
        np.minimum(low, (np.multiply.outer(_MULTIPLY, grams[at : at + 4096]) + _ADD[:, None]).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def least_agreement(percent: int) -> int:
    """Equal minima below which a pair at ``percent`` similarity is out of reach."""
    s = percent / 100
    return max(ROWS, int(np.floor(MINIMA * s - 4.5 * np.sqrt(MINIMA * s * (1 - s)))))


def _sign(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n, one, two, sig = [], [], [], []
                for grams in shingle_sets(part.column("text"), size):
                    n.append(len(grams))
                    one.append(mix(grams).sum(dtype=np.uint64))
                    two.append(mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
                    sig.append(signature(grams).tobytes() if len(grams) else None)
                yield pa.record_batch(
                    [
                        part.column("doc_id"),
                        pa.array(n, pa.int64()),
                        pa.array(np.array(one, dtype=np.uint64).view(np.int64)),
                        pa.array(np.array(two, dtype=np.uint64).view(np.int64)),
                        pa.array(sig, pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "d1", "d2", "sig"],
                )

    return run


def _sets(size: int, wanted: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            keep = batch.filter(pa.array(bitmap.contains(wanted.value, ids.astype(np.int64))))
            for part in slices(keep, "text"):
                grams = [g.tobytes() for g in shingle_sets(part.column("text"), size)]
                yield pa.record_batch([part.column("doc_id"), pa.array(grams, pa.binary())], ["id", "grams"])

    return run


def _held_in(held: Broadcast, column: str, inside: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows whose long in ``column`` may be in the bitmap, or those where it is not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(column).to_numpy(zero_copy_only=False).astype(np.int64)
            yield batch.filter(pa.array(bitmap.contains(held.value, keys) == inside))

    return run


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Are two sorted sets at least ``percent`` similar?"""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or len(x) * 100 < percent * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _join_blocks(least: int, percent: int) -> Callable[[pa.Table], pa.Table]:
    """Links inside one pair of blocks of a family.

    A pair is looked at if it shares a band and its signatures agree, and
    confirmed on the full sets; documents that links have joined are one
    component from then on and are not compared again, so what comes out is at
    most one link a document."""

    def run(table: pa.Table) -> pa.Table:
        ids, side = (table[c].to_numpy() for c in ("id", "side"))
        _, comp = np.unique(ids, return_inverse=True)
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint32).reshape(-1, MINIMA)
        grams = [np.frombuffer(g, np.uint64) for g in table["grams"].to_pylist()]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == side.max())
        a, b = [], []
        for i in left:
            other = right if side.max() else right[right > i]
            for at in range(0, len(other), 4096):
                some = other[at : at + 4096]
                some = some[comp[some] != comp[i]]
                same = sig[some] == sig[i]
                agree = same.sum(axis=1)
                near = np.flatnonzero(agree >= least)
                near = near[same[near].reshape(-1, BANDS, ROWS).all(axis=2).any(axis=1)]
                for j in some[near[np.argsort(-agree[near], kind="stable")]]:  # the likeliest first
                    if comp[j] != comp[i] and _alike(grams[i], grams[j], percent):
                        a.append(int(ids[i]))
                        b.append(int(ids[j]))
                        comp[comp == comp[j]] = comp[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, shingle: int = 4, percent: int = 80, bitmap_bits: int = bitmap.MOST_BITS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest ``doc_id`` reachable over links
    of at least ``percent`` / 100 Jaccard similarity) and kept, for every row."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with Scratch(spark, "near_duplicates") as scratch:
        base = scratch.table(
            texts.mapInArrow(_sign(shingle), "doc_id long, n_shingles long, d1 long, d2 long, sig binary"), "signatures"
        )
        own = base.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        # written, so that the joins back read plain shuffles, whose hot partitions are split
        repeated = own.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).filter("rep < last")
        repeated = scratch.table(repeated.select("d1", "d2", "rep"), "repeated")
        row = F.xxhash64("doc_id", "d1", "d2").alias("row")  # an id may have several texts
        copies = own.select("doc_id", "d1", "d2").join(repeated, ["d1", "d2"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"), row).filter("a <> b")
        copies = scratch.table(copies, "copies")
        # signatures stay where they were written: a bitmap tells nearly all first
        # copies apart, and only the rows it holds go through an exact join
        copied = bitmap.build(copies.select("row").distinct(), "row", scratch, bitmap_bits)
        signed = own.select(F.col("doc_id").alias("id"), row, "sig")
        doubtful = signed.mapInArrow(_held_in(copied, "row", True), signed.schema).join(copies, "row", "left_anti")
        reps = signed.mapInArrow(_held_in(copied, "row", False), signed.schema).unionByName(doubtful)

        band = F.explode(F.array(*[F.xxhash64(F.lit(i), F.substring("sig", 4 * ROWS * i + 1, 4 * ROWS)) for i in range(BANDS)]))
        bucket = reps.select("id", band.alias("bucket"))
        shared = bucket.groupBy("bucket").agg(F.min("id").alias("centre"), F.max("id").alias("last")).filter("centre < last")
        members = scratch.table(bucket.join(shared, "bucket").select("bucket", "id", "centre").distinct(), "members")

        wanted = bitmap.build(members.select("id").distinct(), "id", scratch, bitmap_bits)
        reps = reps.mapInArrow(_held_in(wanted, "id", True), signed.schema).dropDuplicates(["id", "row"]).select("id", "sig")
        known = texts.filter("doc_id IS NOT NULL")
        sets = scratch.table(
            known.mapInArrow(_sets(shingle, wanted), "id long, grams binary").join(members.select("id").distinct(), "id", "left_semi"), "sets"
        )
        stars = members.filter("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
        family = components(stars, scratch, "family").withColumnsRenamed({"node": "id", "component": "family"})
        placed = scratch.table(family.join(reps, "id").join(sets, "id").select("family", "id", "sig", "grams"), "families")
        size = placed.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("grams")).alias("bytes"))
        size = size.select("family", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
        block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        dealt = placed.join(size, "family").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select(
            "family",
            F.least("block", "other").alias("i"),
            F.greatest("block", "other").alias("j"),
            (F.col("block") > F.col("other")).cast("int").alias("side"),
            "id",
            "sig",
            "grams",
        )
        confirm = _join_blocks(least_agreement(percent), percent)
        close = scratch.table(dealt.groupBy("family", "i", "j").applyInArrow(confirm, "a long, b long"), "links")
        nodes = components(close.unionByName(copies.select("a", "b")), scratch, "all")
        out = base.select("doc_id", "n_shingles").join(nodes.withColumnsRenamed({"node": "doc_id"}), "doc_id", "left")
        out = out.select(
            "doc_id",
            "n_shingles",
            F.coalesce("component", "doc_id").alias("component_id"),
            F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"),
        )
        return scratch.keep(out, "result")


def keep_one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80, bitmap_bits: int = bitmap.MOST_BITS) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest id of its group."""
    name = fresh_name(docs, "_gone")
    gone = near_duplicates(docs, shingle, percent, bitmap_bits).filter("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
