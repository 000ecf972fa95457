"""Benchmark decontamination with spaced seeds.

Fixed masks choose five of several neighbouring words and ignore the words
between, so a substituted word does not hide a copy.  The masked hashes of
the benchmark form a table; the training side is scanned once, and places
whose hash may be there (a bitmap thins them) meet the table in an exact join
on the hash, which gives (document, item, diagonal) hits without any words.
A second scan of the documents that are left takes the words beside each
item's diagonal, and these are verified word by word: a leak is a stretch of
at least ``min_words`` words (or the whole item, if shorter), at least
``percent`` of them equal, and the stretch is found whole, however long.

A phrase common to many documents and items does not become all their pairs:
every overlap of 13 to 25 words with at least 80 percent equal has two hits or
more on its diagonal (all patterns of substitutions were enumerated), and a
longer overlap has a part of 13 to 25 words that is one itself.  So a place
without another hit within 25 words is dropped before it meets the items, and
a diagonal with one hit after that.  Only items shorter than 13 words, and
settings below 13 words or 80 percent, go by single hits.

Nothing about the benchmark is assumed small: its table is joined by shuffle
unless adaptive execution measures it small, and the bitmaps are bounded.

Cases: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; null or blank
texts on either side match nothing; items of fewer than five words are looked
up as whole sequences, those of five and six with any one word left out; a null ``doc_id`` or ``item_id`` is carried and
matched like any other; equal rows give one finding each id; empty tables
give no findings; other columns pass through ``drop_contaminated`` unchanged,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch
from . import bitmap
from .words import Words, fresh_name, longs, mix, ragged, slices, split_words

# The masks; 1 compares a word, 0 ignores it.
MASKS = ("11111", "1110011", "1101011", "11001101", "101101001")
WEIGHT = 5
SHORT = 6  # items of at most so many words have masks of their own
# Within so many words, an overlap of so many words at so many percent has two hits.
DENSE_SPAN, DENSE_WORDS, DENSE_PERCENT = 25, 13, 80
KEY, ITEM = "_leak_key", "_item_key"


def masked(words: Words, mask: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the masked words at every place where the mask fits into one
    document, and the index of the place's first word."""
    n = len(words.hash) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out = np.full(n, number + 1, dtype=np.uint64)
    for i, chosen in enumerate(mask):
        if chosen == "1":
            out = out * np.uint64(0x9E3779B97F4A7C15) + words.hash[i : i + n]
    last = np.repeat(words.first[1:], np.diff(words.first))[:n]
    at = np.flatnonzero(np.arange(n) + len(mask) <= last)
    return mix(out[at]), at


def _masks(short: tuple[int, ...]) -> list[str]:
    """MASKS, and for items of just ``n`` words a mask of all, or from ``WEIGHT``
    words on one for each word that may be substituted."""
    left_out = [("1" * i + "0" + "1" * (n - i - 1)) for n in short if n >= WEIGHT for i in range(n)]
    return [*MASKS, *("1" * n for n in short if n < WEIGHT), *left_out]


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = split_words(part.column("text"), lower=True)
            lists = pa.ListArray.from_arrays(pa.array(words.first.astype(np.int32)), longs(words.hash))
            yield pa.record_batch([part.column(ITEM), part.column("item_id"), lists], [ITEM, "item_id", "item_words"])


def _item_seeds(short: tuple[int, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = split_words(part.column("text"), lower=True)
                n = np.diff(words.first)
                for number, mask in enumerate(_masks(short)):
                    seed, at = masked(words, mask, number)
                    row = np.searchsorted(words.first, at, side="right") - 1
                    if number >= len(MASKS):  # only items of just that length
                        whole = n[row] == len(mask)
                        seed, at, row = seed[whole], at[whole], row[whole]
                    place = (at - words.first[row]).astype(np.int32)
                    columns = [part.column(ITEM).take(pa.array(row)), longs(seed), pa.array(place), pa.array(n[row].astype(np.int32))]
                    yield pa.record_batch(columns, [ITEM, "seed", "place", "n"])

    return run


def _hits(short: tuple[int, ...], dense: Broadcast, single: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Places of documents whose masked hash may be a benchmark item's: hashes of
    ``dense`` only with another within DENSE_SPAN words, those of ``single`` alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = split_words(part.column("text"), lower=True)
                seeds, places = [], []
                for number, mask in enumerate(_masks(short)):
                    seed, at = masked(words, mask, number)
                    near = bitmap.contains(dense.value, seed) | bitmap.contains(single.value, seed)
                    seeds.append(seed[near])
                    places.append(at[near])
                seed, at = np.concatenate(seeds), np.concatenate(places)
                order = np.argsort(at, kind="stable")
                seed, at = seed[order], at[order]
                doc = np.searchsorted(words.first, at, side="right") - 1
                close = (doc[1:] == doc[:-1]) & (at[1:] - at[:-1] <= DENSE_SPAN)
                keep = bitmap.contains(single.value, seed)
                keep[1:] |= close
                keep[:-1] |= close
                seed, at, doc = seed[keep], at[keep], doc[keep]
                place = pa.array((at - words.first[doc]).astype(np.int32))
                yield pa.record_batch([part.column(KEY).take(pa.array(doc)), longs(seed), place], [KEY, "seed", "at"])

    return run


def _has_candidate(marked: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bitmap.contains(marked.value, batch.column(KEY).to_numpy())))

    return run


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of a document that lie beside an item on a candidate diagonal."""
    for batch in batches:
        for part in slices(batch, "text"):
            words = split_words(part.column("text"), lower=True)
            flat = part.column("diagonals").flatten()
            row = np.repeat(np.arange(len(part)), part.column("diagonals").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            shift, n = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("shift", "n"))
            size = np.diff(words.first)[row]
            lo, hi = np.maximum(shift, 0), np.minimum(shift + n, size)
            count = np.maximum(hi - lo, 0)
            for at in range(0, len(row), 4096):  # many diagonals of one document do not make one batch
                some = slice(at, at + 4096)
                ends = np.concatenate([[0], np.cumsum(count[some])]).astype(np.int32)
                taken = words.hash[ragged(words.first[row[some]] + lo[some], count[some])]
                rows = pa.array(row[some])
                columns = [part.column("doc_id").take(rows), part.column(KEY).take(rows), flat.field(ITEM)[at : at + 4096], pa.array(shift[some].astype(np.int32))]
                columns += [pa.array(lo[some].astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), longs(taken))]
                yield pa.record_batch(columns, ["doc_id", KEY, ITEM, "shift", "start", "words"])


def longest_overlap(equal: np.ndarray, least: int, percent: int) -> tuple[int, int] | None:
    """The longest stretch [a, b) of at least ``least`` places of which at least
    ``percent`` are equal (the first of several), or None."""
    if len(equal) < least:
        return None
    score = np.concatenate([[0], np.cumsum(np.where(equal, 100 - percent, -percent))])
    low = np.minimum.accumulate(score[: len(score) - least])
    good = np.flatnonzero(score[least:] >= low)
    if not len(good):
        return None
    first = np.searchsorted(-low, -score[good + least])  # earliest start with a score not above
    best = int(np.argmax(good + least - first))
    return int(first[best]), int(good[best] + least)


def _verify(min_words: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, start, end, equal_words = [], [], [], []
            text, item = batch.column("words"), batch.column("item_words")
            shift, base = batch.column("shift").to_numpy(), batch.column("start").to_numpy()
            for i in range(len(batch)):
                t, q = text[i].values.to_numpy(), item[i].values.to_numpy()
                equal = t == q[base[i] - shift[i] :][: len(t)]
                found = longest_overlap(equal, min(min_words, len(q)), percent)
                if found:
                    rows.append(i)
                    start.append(base[i] + found[0])
                    end.append(base[i] + found[1])
                    equal_words.append(int(equal[found[0] : found[1]].sum()))
            some = batch.select(["doc_id", KEY, "item_id"]).take(pa.array(rows, pa.int64()))
            yield pa.record_batch(
                [*some.columns, pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(equal_words, pa.int32())],
                ["doc_id", KEY, "item_id", "start", "end", "equal_words"],
            )

    return run


def _key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _candidates(texts: DataFrame, items: DataFrame, short: tuple[int, ...], min_words: int, percent: int, bits: int, scratch: Scratch) -> DataFrame:
    """(key of the document, key of the item, diagonal, words of the item) that
    have hits enough to be an overlap."""
    seeds = items.mapInArrow(_item_seeds(short), f"{ITEM} long, seed long, place int, n int").distinct()
    alone = (F.col("n") < DENSE_WORDS) if min_words >= DENSE_WORDS and percent >= DENSE_PERCENT else F.lit(True)
    seeds = scratch.table(seeds.withColumn("alone", alone), "item_seeds")
    dense, single = (bitmap.build(seeds.filter(c).select("seed").distinct(), "seed", scratch, bits) for c in (~F.col("alone"), F.col("alone")))
    near = texts.mapInArrow(_hits(short, dense, single), f"{KEY} long, seed long, at int").distinct()
    # what the bitmaps let through in vain goes first, then places that stand alone
    real = near.join(seeds.groupBy("seed").agg(F.max("alone").alias("alone")), "seed")
    places = Window.partitionBy(KEY).orderBy("at", "seed")  # of one document
    before, after = F.lag("at", 1, -DENSE_SPAN - 1).over(places), F.lead("at").over(places)
    close = (F.col("at") - before <= DENSE_SPAN) | F.coalesce(after - F.col("at") <= DENSE_SPAN, F.lit(False))
    hits = scratch.table(real.withColumn("close", close).filter("alone OR close").select(KEY, "seed", "at"), "hits")
    diagonal = (F.col("at") - F.col("place")).alias("shift")
    met = hits.join(seeds, "seed").groupBy(KEY, ITEM, diagonal).agg(F.count(F.lit(1)).alias("hits"), F.max("n").alias("n"), F.max("alone").alias("alone"))
    return scratch.table(met.filter("alone OR hits > 1").select(KEY, ITEM, "shift", "n"), "candidates")


def _findings(docs: DataFrame, benchmark: DataFrame, min_words: int, percent: int, bits: int, scratch: Scratch) -> DataFrame:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.withColumn(ITEM, F.xxhash64("item_id", "text"))
    item_words = items.mapInArrow(_item_words, f"{ITEM} long, item_id long, item_words array<long>")
    item_words = scratch.table(item_words.filter("size(item_words) > 0").dropDuplicates([ITEM]), "items")
    lengths = item_words.filter(F.size("item_words") <= SHORT).agg(F.collect_set(F.size("item_words"))).first()[0]
    short = tuple(sorted(lengths))  # at most 1 to SHORT

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _key().alias(KEY))
    found = _candidates(texts, items, short, min_words, percent, bits, scratch)
    grouped = found.groupBy(KEY).agg(F.collect_list(F.struct(ITEM, "shift", "n")).alias("diagonals"))
    marked = bitmap.build(found.select(KEY).distinct(), KEY, scratch, bits)
    left = texts.mapInArrow(_has_candidate(marked), texts.schema).dropDuplicates([KEY]).join(grouped, KEY)
    beside = left.select("doc_id", "text", KEY, "diagonals").mapInArrow(_beside, f"doc_id long, {KEY} long, {ITEM} long, shift int, start int, words array<long>")
    wide = beside.join(item_words, ITEM).select("doc_id", KEY, "item_id", "shift", "start", "words", "item_words")
    return wide.mapInArrow(_verify(min_words, percent), f"doc_id long, {KEY} long, item_id long, start int, end int, equal_words int")


def contamination(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, percent: int = 80, bitmap_bits: int = bitmap.MOST_BITS) -> DataFrame:
    """One row for each document and benchmark item it holds: doc_id, item_id,
    the longest leaked stretch [start, end) in words of the document, how many of
    its words equal the item's, and the number of verified diagonals."""
    with Scratch(docs.sparkSession, "decontaminate") as scratch:
        found = _findings(docs, benchmark, min_words, percent, bitmap_bits, scratch)
        longest = F.max(F.struct((F.col("end") - F.col("start")).alias("n"), (-F.col("start")).alias("s"), "end", "equal_words"))
        out = found.groupBy("doc_id", "item_id").agg(longest.alias("best"), F.count(F.lit(1)).alias("matches"))
        out = out.select(
            "doc_id", "item_id", (-F.col("best.s")).alias("start"), F.col("best.end").alias("end"), F.col("best.equal_words").alias("equal_words"), "matches"
        )
        return scratch.keep(out, "result")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, percent: int = 80, bitmap_bits: int = bitmap.MOST_BITS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    with Scratch(docs.sparkSession, "decontaminate") as scratch:
        found = _findings(docs, benchmark, min_words, percent, bitmap_bits, scratch)
        name = fresh_name(docs, "_bad")
        bad = scratch.keep(found.select(F.col(KEY).alias(name)).distinct(), "bad")
    return docs.join(bad, _key() == F.col(name), "left_anti")
