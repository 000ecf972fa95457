"""Toxicity: averaged subword embeddings under a linear softmax.

A word is the average of the vectors of its pieces: the whole word and its
character n-grams (over UTF-8 bytes, with word ends marked), each hashed to
one of ``BUCKETS`` rows.  A document is the average of its words, common
words weighing less, and a linear softmax over two classes gives the score.  Vectors and softmax are
trained jointly in numpy (full-batch Adam), so a misspelt or inflected word
that was never seen is scored through the n-grams it shares.  Every bucket of
the sample has a vector; it counts by how far the bucket's documents differ
between the classes in standard errors, or the many pieces of one or two
documents would learn the sample by heart.

Training runs in one task on a bounded sample of labelled rows: at most ``SAMPLE`` of each
class in the order of a hash of the id, among the ids that have a text of at most
``SAMPLE_CHARS`` characters.  A fifth of the sample calibrates slope and bias,
classes weighted to their share of all labelled rows.  Because the model is linear in the averaged
vectors, scoring needs one number for each bucket (2 MB in all), which is
broadcast; whole texts are scored in one pass without a shuffle.

Cases: null or blank texts have no words and get the score of the bias
alone; labels other than 0 and 1, null labels and ids, and ids whose labels
disagree are not learnt from; without examples of both classes every score
is the toxic share (0 without labels); equal rows get equal scores; empty
tables give no rows; other columns are ignored or, in ``drop_toxic``, kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import Words, mix, ragged, slices, split_words

BUCKETS = 1 << 18
GRAMS = (3, 4, 5)
DIM = 2
CHANCE = 3.0  # standard errors at which half of a bucket's vector counts
# power by which chance differences between the classes fade: of 1, 2, 4, 6, 8 and 12 the one with the best
# accuracy in a four-fold cross-validation over the labelled rows of sf0.1 that are not held out
STEEP = 8
RARE = 5e-3  # share of all words at which a word counts half in the average
EPOCHS = 80
RATE = 0.2
DECAY = 5e-6
SAMPLE = 1500  # labelled rows of a class at most
SAMPLE_CHARS = 20_000  # longest text in the sample (texts are taken whole)
FOLDS = 5  # ids with crc32 of 0 modulo this are held out


def held_out(doc_id: str = "doc_id") -> Column:
    """Ids that labels are never learnt from (null ids too)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(True))


@dataclass
class Pieces:
    """Distinct words of a slice: their pieces (buckets) end to end, where each
    word's pieces begin, and each text word's row among the distinct ones."""

    bucket: np.ndarray
    first: np.ndarray
    word: np.ndarray


def pieces(words: Words) -> Pieces:
    _, one, back = np.unique(words.hash, return_index=True, return_inverse=True)
    length = (words.end - words.start)[one]
    wide = length + 2
    begin = np.concatenate([[0], np.cumsum(wide)])
    text = np.empty(int(begin[-1]), dtype=np.uint16)
    text[ragged(begin[:-1] + 1, length)] = words.data[ragged(words.start[one], length)]
    text[begin[:-1]], text[begin[1:] - 1] = 256, 257  # word ends
    counts = [np.ones_like(wide), *(np.maximum(wide - n + 1, 0) for n in GRAMS)]
    first = np.concatenate([[0], np.cumsum(np.sum(counts, axis=0))])
    bucket = np.empty(int(first[-1]), dtype=np.int32)
    bucket[first[:-1]] = words.hash[one] % np.uint64(BUCKETS)  # the word itself comes first
    place = first[:-1] + 1
    for n, count in zip(GRAMS, counts[1:], strict=True):
        at = ragged(begin[:-1], count)
        gram = np.full(len(at), n, dtype=np.uint64)
        for i in range(n):
            gram *= np.uint64(0x100000001B3)
            gram += text[at + i]
        bucket[ragged(place, count)] = mix(gram) % np.uint64(BUCKETS)
        place = place + count
    return Pieces(bucket, first, back)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each run ``values[first[i]:first[i + 1]]`` (runs may be empty)."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), dtype=values.dtype)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, first[full], axis=0)
    return out


@dataclass
class _Sparse:
    """A sparse matrix, cells in the order of their rows, for products in both
    directions (one copy of the cells, a block of them at a time)."""

    shape: tuple[int, int]
    row: np.ndarray
    col: np.ndarray
    value: np.ndarray

    def __post_init__(self) -> None:
        self.row, self.col, self.value = self.row.astype(np.int32), self.col.astype(np.int32), self.value.astype(np.float32)
        self._first = np.searchsorted(self.row, np.arange(self.shape[0] + 1, dtype=np.int32))

    def dot(self, x: np.ndarray) -> np.ndarray:
        return np.stack([_sums(c[self.col] * self.value, self._first) for c in x.T.astype(np.float32)], axis=1)

    def transposed_dot(self, x: np.ndarray, block: int = 1 << 20) -> np.ndarray:
        out = np.zeros((self.shape[1], x.shape[1]))
        for k, c in enumerate(x.T.astype(np.float32)):
            for at in range(0, len(self.row), block):
                some = slice(at, at + block)
                part = np.bincount(self.col[some], c[self.row[some]] * self.value[some])
                out[: len(part), k] += part
        return out.astype(np.float32)


@dataclass
class Model:
    """score = sigmoid(bias + weighted mean over words of mean over pieces of
    ``weight``); ``rarity`` weighs a word by its bucket."""

    weight: np.ndarray
    rarity: np.ndarray
    bias: float

    def logits(self, words: Words) -> np.ndarray:
        mean = np.zeros(len(words.first) - 1)
        if len(words.hash):
            p = pieces(words)
            word = _sums(self.weight[p.bucket], p.first) / np.diff(p.first)
            rarity = self.rarity[p.bucket[p.first[:-1]]]
            mean = _sums((word * rarity)[p.word], words.first) / np.maximum(_sums(rarity[p.word], words.first), 1e-9)
        return mean + self.bias

    def scores(self, words: Words) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(words), -500, 500)))


def _calibrated(logit: np.ndarray, labels: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and bias that turn raw logits into probabilities (Platt's method by
    Newton steps), with the classes weighted to their share of all labelled rows."""
    x = np.stack([logit, np.ones(len(logit))], axis=1)
    weight = np.where(labels == 1, share / max(labels.mean(), 1e-9), (1 - share) / max(1 - labels.mean(), 1e-9))
    line = np.array([1.0, 0.0])
    for _ in range(50):
        prob = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        slope = x.T @ (weight * (prob - labels)) + 1e-3 * (line - [1, 0])
        line = line - np.linalg.solve((x * (weight * prob * (1 - prob) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2), slope)
    return (float(line[0]), float(line[1])) if np.all(np.isfinite(line)) and line[0] > 0 else (1.0, 0.0)


def fit(texts: pa.Array, labels: np.ndarray, share: float) -> Model:
    """Train vectors and softmax jointly on four fifths of the sample, then
    calibrate on the rest; ``share`` of all labelled rows are toxic."""
    rest = np.arange(len(labels)) % 5 == 4
    if len(set(labels[~rest].tolist())) == len(set(labels[rest].tolist())) == 2:
        model = _joint(texts.filter(pa.array(~rest)), labels[~rest], share)
        words = split_words(texts.filter(pa.array(rest)), lower=True)
        slope, bias = _calibrated(model.logits(words), labels[rest], share)
        return Model(model.weight * slope, model.rarity, model.bias * slope + bias)
    return _joint(texts, labels, share)


def _constant(share: float) -> Model:
    """The model without examples of both classes: the toxic share for every text."""
    bias = float(np.log(share) - np.log1p(-share)) if 0 < share < 1 else (-500.0 if share <= 0 else 500.0)
    return Model(np.zeros(BUCKETS), np.ones(BUCKETS), bias)


def _evidence(docs: _Sparse, p: Pieces, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents that hold each bucket, and a share from 0 to 1 by the standard
    errors between its toxic documents and those expected by chance."""
    n_pieces, held = np.diff(p.first), np.zeros((2, BUCKETS))
    for d, label in enumerate(labels):  # one document at a time: few cells are held
        words = docs.col[docs._first[d] : docs._first[d + 1]]
        held[label, np.unique(p.bucket[ragged(p.first[words], n_pieces[words])])] += 1
    both, toxic = held.sum(axis=0), labels.mean()
    errors = (held[1] - toxic * both) / np.sqrt(toxic * (1 - toxic) * both * (1 - both / (len(labels) + 1)) + 1)
    power = np.abs(errors) ** STEEP
    return both, power / (power + CHANCE**STEEP)


def _joint(texts: pa.Array, labels: np.ndarray, share: float) -> Model:
    if len(set(labels.tolist())) < 2:
        return _constant(share)
    words = split_words(texts, lower=True)
    p = pieces(words)
    n_pieces, own, doc = np.diff(p.first), p.bucket[p.first[:-1]], words.doc()
    common = np.bincount(own[p.word], minlength=BUCKETS) / len(p.word)
    rarity = RARE / (RARE + common)
    total = np.maximum(_sums(rarity[own][p.word], words.first), 1e-9)
    cell, count = np.unique(doc * len(n_pieces) + p.word, return_counts=True)
    docs = _Sparse((len(labels), len(n_pieces)), cell // len(n_pieces), cell % len(n_pieces), count * rarity[own][cell % len(n_pieces)] / total[cell // len(n_pieces)])
    owner = np.repeat(np.arange(len(n_pieces), dtype=np.int32), n_pieces)
    uses, evidence = _evidence(docs, p, labels)
    kept = np.flatnonzero(uses)
    place = np.zeros(BUCKETS, dtype=np.int32)
    place[kept] = np.arange(len(kept))
    value = (1 / n_pieces).astype(np.float32)[owner] * evidence.astype(np.float32)[p.bucket]
    parts = _Sparse((len(n_pieces), len(kept)), owner, place[p.bucket], value)
    del owner, value, uses, words, p, cell, count, doc, own  # hold only what training needs

    rng = np.random.default_rng(3)
    params = [np.zeros((len(kept), DIM), np.float32), rng.normal(0, 0.5, (2, DIM)).astype(np.float32), np.zeros(2, np.float32)]
    mean, square = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    target = np.eye(2, dtype=np.float32)[labels]
    weight = (0.5 / np.bincount(labels, minlength=2)).astype(np.float32)  # both classes weigh the same
    for step in range(1, EPOCHS + 1):
        vectors, softmax, bias = params
        hidden = docs.dot(parts.dot(vectors))
        logit = hidden @ softmax.T + bias
        prob = np.exp(logit - logit.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        error = (prob - target) * weight[labels, None]
        slope = [parts.transposed_dot(docs.transposed_dot(error @ softmax)) + DECAY * vectors, error.T @ hidden + DECAY * softmax, error.sum(axis=0)]
        for i, g in enumerate(slope):
            g = g.astype(np.float32)
            mean[i] += 0.1 * (g - mean[i])
            square[i] += 0.01 * (g * g - square[i])
            params[i] = params[i] - RATE * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-12)
    vectors, softmax, bias = params
    prior = np.log(share / (1 - share))
    weights = np.zeros(BUCKETS)
    weights[kept] = vectors @ (softmax[1] - softmax[0]) * evidence[kept]
    return Model(weights, rarity, float(bias[1] - bias[0] + prior))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled rows of ``docs`` that are not held out."""
    marks = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic")).filter(
        F.col("toxic").isin(0, 1) & F.col("_id").isNotNull() & ~held_out("_id")
    )
    marks = marks.groupBy("_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).filter("toxic = _most").select("_id", "toxic")
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    pick = F.xxhash64(F.lit("sample"), "_id")
    short = docs.filter(F.length("text") <= SAMPLE_CHARS).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    usable = marks.join(short.select(F.col("doc_id").alias("_id")), "_id", "left_semi")
    picked = [usable.filter(F.col("toxic") == k).orderBy(pick, "_id").limit(SAMPLE) for k in (0, 1)]
    chosen = picked[0].unionByName(picked[1])  # at most 2 * SAMPLE rows: bounded for broadcast
    rows = short.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    # one task trains on the bounded sample; the driver sees the model only
    fitted = rows.select("doc_id", "toxic", "text").repartition(1).mapInArrow(_train(share), "weight binary, rarity binary, bias double").toArrow()
    if not fitted.num_rows:
        return _constant(share)
    row = fitted.to_pylist()[0]
    return Model(np.frombuffer(row["weight"]), np.frombuffer(row["rarity"]), row["bias"])


def _train(share: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if sum(map(len, held)):
            sample = pa.Table.from_batches(held)
            order = np.argsort(mix(sample["doc_id"].to_numpy().view(np.uint64)), kind="stable")  # classes mixed
            sample = sample.take(pa.array(order))
            model = fit(sample["text"].combine_chunks(), sample["toxic"].to_numpy().astype(np.int64), share)
        else:
            model = _constant(share)
        parts = [pa.array([model.weight.tobytes()], pa.binary()), pa.array([model.rarity.tobytes()], pa.binary()), pa.array([model.bias])]
        yield pa.record_batch(parts, ["weight", "rarity", "bias"])

    return run


def _score(model: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                score = model.value.scores(split_words(part.column("text"), lower=True))
                yield pa.record_batch([part.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score in [0, 1] and predicted (1 from 0.5 on) for every row."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(_score(model), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _clean(model: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                scores = model.value.scores(split_words(part.column("text"), lower=True))
                yield part.filter(pa.array(scores < 0.5))

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns kept."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return docs.mapInArrow(_clean(model), docs.schema)
