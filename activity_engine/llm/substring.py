"""Substring dedup by seed and extend.

A repeat is a run of at least ``min_words`` words that also starts in a
document with a smaller id.  Method, a few
passes over the text and no shuffle of texts without repeats:

1. Seeds.  Runs of ``SEED`` words are winnowed over ``min_words - SEED + 1``
   neighbours: the seed of a run of ``min_words`` words is the least hash
   among its runs of ``SEED``, the same wherever it occurs.  Seeds found in two ids are joined (grouped
   with partial sums, so a seed of a third of all documents is one row a
   task) and kept as a bitmap of fixed size.
2. Extension.  Around each shared seed the match is extended to both sides:
   every window of ``min_words`` words anchored at it is fingerprinted (128
   bits) and meets its other occurrences.  Windows are
   compared with the first document that holds them, never pair by pair, so
   a passage in many documents costs a row for each, not for each pair.
3. Runs of matching windows are merged into maximal repeats and cut.

Whole copies of a text under a smaller id are found first by two hashes of
the text: they match throughout and take no part in the other steps.

Cases: null or blank texts have no words and no repeats; equal rows and rows
with equal ids never count as each other's earlier copy; a null ``doc_id`` is
not smaller than any and loses nothing; repeats inside one document stay;
empty tables give no rows; other columns pass through ``cut_repeats``
unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from . import bitmap
from .words import Words, longs, slices, split_words, text_bytes, window_hash

SEED = 20  # words of a seed (fewer when min_words is smaller)
_SECOND = 0xC2B2AE3D27D4EB4F  # base of the second half of a fingerprint
KEY, STARTS = "_repeat_key", "_repeat_starts"


def _sliding(values: np.ndarray, size: int, best: Callable) -> np.ndarray:
    """``best`` over each run of ``size`` neighbours, by doubling."""
    out, have = values, 1
    while have < size:
        step = min(have, size - have)
        out = best(out[: len(out) - step], out[step:])
        have += step
    return out


def winnow(words: Words, min_words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of ``min_words`` words inside one document: its seed, the
    least hash of the runs of ``seed`` words in it, and its first word."""
    grams, at = window_hash(words, seed)
    span = min_words - seed + 1
    if len(grams) < span:
        return grams[:0], at[:0]
    inside = at[span - 1 :] - at[: len(at) - span + 1] == span - 1
    return _sliding(grams, span, np.minimum)[inside], at[: len(at) - span + 1][inside]


def _unlike(batches: Iterator[pa.RecordBatch], skip: Broadcast | None) -> Iterator[pa.RecordBatch]:
    """The rows whose key is not in the bitmap ``skip`` (all without one)."""
    for batch in batches:
        if skip is not None:
            batch = batch.filter(pa.array(~bitmap.contains(skip.value, batch.column(KEY).to_numpy())))
        yield batch


def _seeds(min_words: int, seed: int, skip: Broadcast | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unlike(batches, skip):
            for part in slices(batch, "text"):
                words = split_words(part.column("text"))
                least, at = winnow(words, min_words, seed)
                doc = np.searchsorted(words.first, at, side="right") - 1
                # neighbours mostly share their seed: one row a stretch
                new = np.ones(len(at), dtype=bool)
                new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
                yield pa.record_batch([longs(least[new]), part.column("doc_id").take(pa.array(doc[new]))], ["seed", "doc_id"])

    return run


def _windows(min_words: int, seed: int, skip: Broadcast | None, shared: Broadcast, again: Broadcast | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Fingerprints of the windows whose seed is shared; on the second run only
    of those that ``again`` holds, with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unlike(batches, skip):
            for part in slices(batch, "text"):
                words = split_words(part.column("text"))
                least, start = winnow(words, min_words, seed)
                one = window_hash(words, min_words)[0]
                near = bitmap.contains(shared.value, least)
                if again is not None:
                    near &= bitmap.contains(again.value, one)
                start, one = start[near], one[near]
                two = window_hash(words, min_words, _SECOND)[0][near] if len(start) else one
                doc = np.searchsorted(words.first, start, side="right") - 1
                rows = pa.array(doc)
                out = [longs(one), longs(two), part.column("doc_id").take(rows)]
                names = ["w1", "w2", "doc_id"]
                if again is not None:
                    out += [part.column(KEY).take(rows), pa.array((start - words.first[doc]).astype(np.int32))]
                    names += [KEY, "start"]
                yield pa.record_batch(out, names)

    return run


def covered(n_words: int, starts: np.ndarray, min_words: int) -> np.ndarray:
    """Which words of a document its matching windows cover (maximal repeats);
    a start of -1 stands for all windows."""
    if len(starts) and starts[0] < 0:
        return np.full(n_words, n_words >= min_words)
    step = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + min_words, -1)
    return np.cumsum(step[:-1]) > 0


def _hit(marked: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows whose key may be in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bitmap.contains(marked.value, batch.column(KEY).to_numpy())))

    return run


def _cut_text(text: bytes, gone: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """The runs of kept words with their own spacing, joined by one space."""
    keep = np.flatnonzero(~gone)
    if not len(keep):
        return b""
    first = keep[np.concatenate([[True], np.diff(keep) > 1])]
    last = keep[np.concatenate([np.diff(keep) > 1, [True]])]
    return b" ".join(text[start[a] : end[b]] for a, b in zip(first, last, strict=True))


def _cut(min_words: int, report: bool, skip: Broadcast | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unlike(batches, skip):
            for part in slices(batch, "text"):
                yield from _cut_slice(part)

    def _cut_slice(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        starts = part.column(STARTS)
        touched = [None if x is None else np.sort(np.array(x, dtype=np.int64)) for x in starts.to_pylist()] if starts.null_count < len(starts) else [None] * len(starts)
        words = split_words(part.column("text")) if any(x is not None for x in touched) else None
        data, offsets = text_bytes(part.column("text"))
        raw = data.tobytes()
        n_words, n_removed, digest, spans, texts = [], [], [], [], part.column("text").to_pylist() if not report else []
        for i, marks in enumerate(touched):
            text = raw[offsets[i] : offsets[i + 1]]
            gone = None
            if marks is not None:
                lo, hi = words.first[i], words.first[i + 1]
                gone = covered(int(hi - lo), marks, min_words)
            if not report:
                if gone is not None:
                    texts[i] = _cut_text(text, gone, words.start[lo:hi] - offsets[i], words.end[lo:hi] - offsets[i]).decode()
                continue
            parts = text.split()  # bytes.split() takes the same six separators
            n_words.append(len(parts))
            n_removed.append(0 if gone is None else int(gone.sum()))
            if gone is not None:
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                spans.append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
                parts = [p for p, g in zip(parts, gone.tolist(), strict=True) if not g]
            else:
                spans.append([])
            digest.append(hashlib.sha256(b" ".join(parts)).hexdigest())
        if report:
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.record_batch(
                [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(spans, span)],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "repeats"],
            )
        else:
            part = part.drop_columns([KEY, STARTS])
            yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(texts, part.schema.field("text").type))

    return run


def _row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _copies(known: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, key) of the rows whose whole text also stands under a smaller id."""
    whole = known.select("doc_id", KEY, F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(9), "text").alias("h2"))
    # written, so that the join back reads plain shuffles, whose hot partitions are split
    lows = scratch.table(whole.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi"), "copied")
    return scratch.table(whole.join(lows, ["h1", "h2"]).filter("doc_id > lo").select("doc_id", KEY).distinct(), "copies")


def _marks(docs: DataFrame, min_words: int, bits: int, scratch: Scratch) -> DataFrame:
    """(doc_id, key of the row, starts of its matching windows or [-1] for all)."""
    seed = min(SEED, min_words)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _row_key().alias(KEY))
    known = texts.filter("doc_id IS NOT NULL")
    # A copy of a whole text matches throughout, and its original speaks for it.
    # The bitmap tells most other rows at once, the join the few it confuses.
    copies = _copies(known, scratch)
    copied = bitmap.build(copies, KEY, scratch, bits)
    confused = scratch.table(known.mapInArrow(_hit(copied), known.schema).join(copies, ["doc_id", KEY], "left_anti").select(*known.columns), "confused")

    def own(function: Callable, *args: object, schema: str) -> DataFrame:
        return known.mapInArrow(function(min_words, seed, copied, *args), schema).unionByName(confused.mapInArrow(function(min_words, seed, None, *args), schema))

    seeds = own(_seeds, schema="seed long, doc_id long")
    common = seeds.groupBy("seed").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
    shared = bitmap.build(scratch.table(common.select("seed"), "seeds"), "seed", scratch, bits)

    first = own(_windows, shared, None, schema="w1 long, w2 long, doc_id long")
    lows = first.groupBy("w1", "w2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("w1", "w2", "lo")
    lows = scratch.table(lows, "windows")
    again = bitmap.build(lows, "w1", scratch, bits)
    places = own(_windows, shared, again, schema=f"w1 long, w2 long, doc_id long, {KEY} long, start int")
    later = places.join(lows, ["w1", "w2"]).filter("doc_id > lo")
    # equal rows make equal marks: a set, at most one entry a word of the text
    marks = later.groupBy("doc_id", KEY).agg(F.collect_set("start").alias(STARTS))
    return scratch.table(marks.unionByName(copies.withColumn(STARTS, F.array(F.lit(-1)))), "marks")


def _apply(docs: DataFrame, min_words: int, report: bool, bits: int, scratch: Scratch) -> DataFrame:
    marks = _marks(docs, min_words, bits, scratch)
    marked = bitmap.build(marks.select(KEY), KEY, scratch, bits)
    if report:
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _row_key().alias(KEY))
    else:
        texts = docs.withColumn(KEY, _row_key())
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string, repeats array<struct<start:int,end:int>>" if report else docs.schema
    plain = texts.withColumn(STARTS, F.lit(None).cast("array<int>")).mapInArrow(_cut(min_words, report, marked), out)
    hit = texts.mapInArrow(_hit(marked), texts.schema)
    on = (F.col("doc_id").cast("long") == F.col("_doc")) & (F.col(KEY) == F.col("_key"))
    hit = hit.join(marks.select(F.col("doc_id").alias("_doc"), F.col(KEY).alias("_key"), STARTS), on, "left").drop("_doc", "_key")
    return plain.unionByName(hit.mapInArrow(_cut(min_words, report, None), out))


def repeat_report(docs: DataFrame, min_words: int = 50, bitmap_bits: int = bitmap.MOST_BITS) -> DataFrame:
    """For each row: doc_id, n_words, n_removed, sha256 of the kept words joined
    by one space, and the maximal repeats as word spans [start, end)."""
    with Scratch(docs.sparkSession, "substring") as scratch:
        return scratch.keep(_apply(docs, min_words, True, bitmap_bits, scratch), "report")


def cut_repeats(docs: DataFrame, min_words: int = 50, bitmap_bits: int = bitmap.MOST_BITS) -> DataFrame:
    """``docs`` with the repeats cut out of ``text``; texts without repeats are
    left byte for byte, other columns too."""
    inside = {c: c if c in ("doc_id", "text") else f"other{i}" for i, c in enumerate(docs.columns)}
    with Scratch(docs.sparkSession, "substring") as scratch:
        cut = scratch.keep(_apply(docs.toDF(*inside.values()), min_words, False, bitmap_bits, scratch), "cut")
    return cut.toDF(*inside)
