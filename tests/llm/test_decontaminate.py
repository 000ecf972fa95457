"""Findings against every alignment of every document and item."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from activity_engine.llm import decontaminate
from activity_engine.llm.decontaminate import MASKS, contamination, drop_contaminated, longest_overlap
from activity_engine.session import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def split(text):
    return WORD.findall((text or "").lower())


def overlap(a, b, least, percent):
    """Every alignment, every stretch."""
    best = 0
    for shift in range(-len(b) + 1, len(a)):
        lo, hi = max(0, shift), min(len(a), len(b) + shift)
        equal = [a[i] == b[i - shift] for i in range(lo, hi)]
        for i in range(len(equal)):
            for j in range(i + least, len(equal) + 1):
                if 100 * sum(equal[i:j]) >= percent * (j - i):
                    best = max(best, j - i)
    return best


def test_masks_have_the_weight():
    assert {m.count("1") for m in MASKS} == {5} and all(m[0] == m[-1] == "1" for m in MASKS)


def test_exact_passages_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in contamination(docs, bench).collect()}
    items = {r.item_id: split(r.text) for r in bench.collect()}
    grams = {}
    for i, w in items.items():
        for p in range(len(w) - 12):
            grams.setdefault(tuple(w[p : p + 13]), set()).add(i)
    want = set()
    for r in docs.collect():
        w = split(r.text)
        for p in range(len(w) - 12):
            want |= {(r.doc_id, i) for i in grams.get(tuple(w[p : p + 13]), ())}
    assert want and want <= got
    # whatever else is found has a substituted word inside a true overlap
    texts = {r.doc_id: split(r.text) for r in docs.filter(docs.doc_id.isin([d for d, _ in got - want])).collect()}
    for d, i in got - want:
        assert overlap(texts[d], items[i], min(13, len(items[i])), 80)
    left = {r.doc_id for r in drop_contaminated(docs, bench).collect()}
    assert left == {r.doc_id for r in docs.select("doc_id").collect()} - {d for d, _ in got}


def test_substitutions_are_found(spark):
    rng = random.Random(4)
    items = [(i, " ".join(f"q{i}_{j}" for j in range(rng.randrange(15, 40)))) for i in range(40)]
    docs = []
    for i, text in items:
        w = text.split()
        for k in range(1, len(w), 6):
            w[k] = "sub"
        docs.append((i, " ".join(["aa"] * rng.randrange(200) + w + ["bb"] * rng.randrange(200))))
    docs += [(100 + i, " ".join(f"q{i}_{j}" for j in range(8)) + " clean " * 30) for i in range(40)]
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = {(r.doc_id, r.item_id) for r in got.collect()}
    assert rows == {(i, i) for i, _ in items}


def test_edge_rows(spark):
    q = " ".join(f"q{i}" for i in range(20))
    docs = [
        (1, None, "a", 1), (2, "", "b", 2), (None, f"x {q} y", "c", 3), (3, f"x {q.upper()}", "d", 4), (3, f"x {q.upper()}", "d", 4),
        (4, "one two three", "e", 5), (5, "one two", "f", 6), (6, "w " * 30000, None, None), (7, " ".join(q.split()[:12]), "g", 7),
    ]
    items = [(1, q, "u"), (1, q, "u"), (2, None, "v"), (3, "", "w"), (None, "one two three", "x"), (4, "w w w w w w", "y")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string, start long")
    b = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id, r.start, r.end) for r in contamination(d, b).collect()}
    assert {g[:2] for g in got} == {(None, 1), (3, 1), (4, None), (6, 4)}
    assert (None, 1, 1, 21) in got and (3, 1, 1, 21) in got and (4, None, 0, 3) in got
    assert sorted(r.doc_id for r in drop_contaminated(d, b).collect()) == [1, 2, 5, 7]
    assert contamination(d.limit(0), b).collect() == [] and contamination(d, b.limit(0)).collect() == []


def test_longest_overlap_against_all_stretches():
    rng = np.random.default_rng(1)
    for _ in range(300):
        equal = rng.random(rng.integers(0, 25)) < rng.random()
        least = int(rng.integers(1, 8))
        all_ = [(j - i, -i, j) for i in range(len(equal)) for j in range(i + least, len(equal) + 1) if 100 * equal[i:j].sum() >= 80 * (j - i)]
        want = max(all_, default=None)
        got = longest_overlap(equal, least, 80)
        assert (got is None) == (want is None) and (got is None or got[1] - got[0] == want[0])


def test_short_items_with_one_substituted_word(spark):
    items = [(n, " ".join(f"s{n}_{j}" for j in range(n))) for n in (4, 5, 6, 7)]
    docs, want = [], set()
    for n, text in items:
        for i in range(n):
            for k in range(i, n):  # one word for i == k, else two
                w = text.split()
                w[i] = w[k] = "sub"
                docs.append((len(docs), " ".join(["aa"] * (i % 3) + w + ["bb"] * k)))
                if 5 * sum(x != "sub" for x in w) >= 4 * n:
                    want.add((docs[-1][0], n))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contamination(docs, items).collect()} == want and len(want) == 5 + 6 + 7
    assert drop_contaminated(docs, items).count() == docs.count() - len(want)


def brute(docs, items, least=13, percent=80):
    """(doc, item) -> longest stretch on any diagonal, by trying every diagonal whole."""
    out = {}
    for d, text in docs:
        t = text.split()
        for i, item in items:
            q = item.split()
            best = None
            for shift in range(-len(q) + 1, len(t)):
                lo, hi = max(0, shift), min(len(t), len(q) + shift)
                equal = np.array([t[x] == q[x - shift] for x in range(lo, hi)], dtype=bool)
                found = longest_overlap(equal, min(least, len(q)), percent) if equal.sum() >= 5 else None
                if found:
                    n = (found[1] - found[0], -(lo + found[0]), int(equal[found[0] : found[1]].sum()))
                    best = max(best, n) if best else n
            if best:
                out[d, i] = (-best[1], best[0] - best[1], best[2])
    return out


def test_extents_equal_brute_force(spark):
    """Start, end and equal words of random copies with long gaps, near and beyond the threshold."""
    rng = random.Random(3)
    items = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([15, 40, 300])))) for i in range(8)]
    docs = []
    for i in range(60):
        _, text = rng.choice(items)
        w = text.split()
        a = rng.randrange(max(1, len(w) - 14))
        w = w[a : a + rng.randint(13, len(w))]
        if rng.random() < 0.5:
            gap = rng.randint(1, max(1, len(w) // 4))
            at = rng.randrange(len(w) - gap + 1)
            w[at : at + gap] = [f"x{j}" for j in range(gap)]
        else:
            w = [x if rng.random() < 0.85 else "sub" for x in w]
        docs.append((i, " ".join([f"p{j}" for j in range(rng.randrange(80))] + w + ["tail"] * rng.randrange(80))))
    want = brute(docs, items)
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): (r.start, r.end, r.equal_words) for r in got.collect()} == want and len(want) > 25


def test_a_stretch_is_found_whole_across_a_long_gap(spark):
    item = [f"w{i}" for i in range(500)]
    text = item[:200] + [f"x{i}" for i in range(100)] + item[300:]
    docs = spark.createDataFrame([(1, " ".join(text))], "doc_id long, text string")
    row = contamination(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [tuple(r) for r in row] == [(1, 7, 0, 500, 400, 1)]


def test_common_phrase_does_not_make_pairs(spark):
    """2,000 documents and 500 items share one five-word phrase and nothing else."""
    phrase = "the same five plain words"
    items = [(i, " ".join([f"i{i}_{j}" for j in range(12)] + [phrase] + [f"j{i}_{j}" for j in range(12)])) for i in range(500)]
    docs = [(i, " ".join([f"d{i}_{j}" for j in range(40)] + [phrase] + [f"e{i}_{j}" for j in range(40)])) for i in range(2000)]
    docs += [(5000, "before " + items[9][1] + " after")]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    with Scratch(spark, "phrase") as scratch:
        texts = docs.withColumn(decontaminate.KEY, F.xxhash64("doc_id", "text"))
        keyed = items.withColumn(decontaminate.ITEM, F.xxhash64("item_id", "text"))
        found = decontaminate._candidates(texts, keyed, (), 13, 80, 28, scratch)
        hits = spark.read.parquet(scratch._written["hits"])
        met = hits.join(spark.read.parquet(scratch._written["item_seeds"]), "seed")
        assert found.count() <= 10_000 and met.count() <= 10_000
    assert [(r.doc_id, r.item_id) for r in contamination(docs, items).collect()] == [(5000, 9)]


def test_clashing_column_names(spark):
    q = " ".join(f"q{i}" for i in range(20))
    docs = spark.createDataFrame([(1, q, "a", "b"), (2, "clean", "c", "d")], "doc_id long, text string, _bad string, _leak_key string")
    left = drop_contaminated(docs, spark.createDataFrame([(1, q)], "item_id long, text string"))
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(2, "clean", "c", "d")]
