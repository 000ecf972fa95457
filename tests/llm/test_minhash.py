"""Near-duplicates against all pairs on small tables."""

import itertools
import re

import pytest

from activity_engine.llm.minhash import keep_one_of_each, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, size=4, percent=80):
    sets = []
    for doc_id, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        sets.append((doc_id, grams))
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    inverted = {}
    for i, (d, g) in enumerate(sets):
        for x in g:
            inverted.setdefault(x, []).append(i)
    pairs = set()
    for g in inverted.values():
        pairs.update(itertools.combinations(g, 2))
    for i, j in pairs:
        (a, x), (b, y) = sets[i], sets[j]
        if a is None or b is None:
            continue
        if 100 * len(x & y) >= percent * len(x | y):
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    out = []
    for d, g in sets:
        c = None if d is None else find(d)
        out.append((d, len(g), c, c is None or c == d))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def test_documents_match_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert result(near_duplicates(docs)) == brute(rows)


def test_edge_rows(spark):
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w30", "x")
    rows = [
        (5, base, "a"), (3, near, "b"), (9, base.upper(), None), (9, base.upper(), None), (None, base, "c"),
        (1, None, "d"), (2, "", "e"), (4, " \t\n", "f"), (6, "one two", "g"), (7, "ONE two", "h"), (8, "one two", "i"),
        (10, "v " * 30000, "j"), (11, "v " * 4, "k"), (12, "other text entirely here", "l"), (12, near + " tail", "m"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    assert result(near_duplicates(docs)) == brute([(a, b) for a, b, _ in rows])


def test_chain_of_near_copies(spark):
    words = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(120):
        words = list(words)
        words[(7 * i) % 80] = f"n{i}"
        rows.append((1000 - i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_duplicates(docs)) == brute(rows)


@pytest.mark.parametrize("schema", ["doc_id long, text string, n_shingles int, id long"])
def test_empty_table(spark, schema):
    assert near_duplicates(spark.createDataFrame([], schema)).collect() == []


def test_clashing_column_names(spark):
    docs = spark.createDataFrame([(1, "one two three four five six", "a"), (2, "one two three four five six", "b")], "doc_id long, text string, _gone string")
    left = keep_one_of_each(docs)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(1, "one two three four five six", "a")]
