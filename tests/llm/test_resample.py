"""Importance resampling against a brute-force version, and the interning table."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from activity_engine.llm import resample
from tests.conftest import SMALL

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text):
    words = WORD.findall((text or "").translate(FOLD))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def bucket(gram):
    return zlib.crc32(gram.encode()) % 10_000


def brute(docs, target):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, grams(text)[1]))
    for text in target:
        t.update(map(bucket, grams(text)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10_000)]
    rows, able = [], []
    for doc_id, text in docs:
        words, features = grams(text)
        weight = sum(gain[bucket(g)] for g in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, len(features), weight, score))
        if len(words) >= 20:
            able.append((-score, doc_id is not None, doc_id or 0, len(rows) - 1))
    rank = {at: i + 1 for i, (*_, at) in enumerate(sorted(able)[: 25 * len(able) // 100])}
    return sorted(((*r, rank.get(i)) for i, r in enumerate(rows)), key=repr)


def got(out):
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted(map(tuple, out.collect()), key=repr)


def test_equals_brute_force_on_the_test_tables(spark):
    docs, target = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert got(resample.resample(docs, target)) == want
    drawn = sorted(r[4] for r in want if r[4])
    assert drawn == list(range(1, len(drawn) + 1)) and len(drawn) > 20


def test_odd_texts_ties_and_repeated_rows(spark):
    long_word = "ä" * 70_000
    rows = [
        (1, None), (2, ""), (3, "  --- @@@ "), (4, "One TWO\x00three/four:five`six{seven\x7feight É É"), (None, "null id " * 15),
        (5, f"{long_word} {long_word} {long_word}b " * 8), (6, "x" * 31 + " " + "x" * 32 + " " + "x" * 33), (8, "word " * 40), (8, "word " * 40), (8, "word " * 40), (8, "word " * 40),
    ]
    rows += [(i, "ab cd " * 10 + str(i)) for i in range(20, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([("ab cd ef",), (None,), ("",)], "text string")
    want = brute(rows, ["ab cd ef", None, ""])
    assert got(resample.resample(docs, target)) == want
    clash = docs.withColumns({c: F.lit("x") for c in ("n", "bucket", "score", "rank", "at", "part")})
    assert got(resample.resample(clash, target.withColumn("doc_id", F.lit(1)))) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i} " * 6) for i in range(9)], "doc_id long, text string")
    none = docs.limit(0)
    assert resample.resample(none, docs).collect() == []
    assert got(resample.resample(docs, none)) == brute([(r.doc_id, r.text) for r in docs.collect()], [])


def test_keys_are_xxhash64_and_clashing_keys_are_told_apart_by_bytes():
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdé1") for _ in range(rng.randint(1, 40))) for _ in range(50)) for _ in range(8)] + ["", None]
    g = resample.Grams(pa.array(texts, pa.string()), 2)
    assert [g.text(i) for i in range(len(g.start))] == [
        x.encode() for n in (0, 1) for t in texts for x in ([w for w in grams(t)[0]] if n == 0 else grams(t)[1][len(grams(t)[0]) :])
    ]
    keys = resample.gram_keys(g)
    assert keys.tolist() == [xxhash.xxh64_intdigest(g.text(i)) for i in range(len(keys))]
    for clash in (keys, keys % 3, np.zeros_like(keys)):  # all keys alike: only the bytes tell
        table = resample.Table(g, 10_000, clash.astype(np.uint64))
        names = {}
        for i, slot in enumerate(table.slot):
            assert names.setdefault(slot, g.text(i)) == g.text(i)
        assert len(set(names.values())) == len(names)
        assert all(table.bucket[s] == zlib.crc32(x) % 10_000 for s, x in names.items())
        assert table.count.sum() == len(keys)
