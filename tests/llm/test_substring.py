"""Repeats against a dictionary of all windows on small tables."""

import hashlib
import random
import re

from activity_engine.llm.substring import cut_repeats, repeat_report

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size):
    first = {}
    split = [WORD.findall(t or "") for _, t in rows]
    for (d, _), w in zip(rows, split, strict=True):
        for i in range(len(w) - size + 1):
            if d is not None:
                k = tuple(w[i : i + size])
                first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if d is not None and first[tuple(w[i : i + size])] < d:
                gone[i : i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


def test_documents_match_all_windows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows, 50)
    assert sum(r[2] for r in want) > 0
    assert result(repeat_report(docs)) == want


def test_random_passages(spark):
    rng = random.Random(9)
    passages = [[f"p{j}_{i}" for i in range(30)] for j in range(4)] + [["same"] * 40]
    rows = []
    for d in range(60):
        text = []
        for _ in range(rng.randrange(6)):
            a = rng.choice(passages)
            lo = rng.randrange(10)
            text += a[lo : lo + rng.randrange(31)] + [rng.choice("abc") for _ in range(rng.randrange(3))]
        rows.append((rng.randrange(50), rng.choice([" ", "\n", "\t "]).join(text)))
    rows += [(None, rows[3][1]), (70, None), (71, ""), (72, " \n"), rows[5], rows[5], (80, "x " * 20000), (81, "x " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(repeat_report(docs, min_words=8)) == brute(rows, 8)


def test_cut_keeps_other_columns_and_spacing(spark):
    p = " ".join(f"w{i}" for i in range(12))
    rows = [(2, f"aa\n{p}  bb\tcc", "x", 1), (1, f" {p}\n", "y", 2), (None, None, None, None), (3, "", "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_words string, start long")
    out = cut_repeats(docs, min_words=10)
    assert out.schema == docs.schema
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted([(2, "aa bb\tcc", "x", 1), *rows[1:]], key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lo long")
    assert repeat_report(docs).collect() == [] and cut_repeats(docs).collect() == []


def test_clashing_column_names(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([("x", 1, text, 5), ("y", 2, text + " more", 6)], "_repeat_key string, doc_id long, text string, _key int")
    cut = cut_repeats(docs)
    assert cut.columns == docs.columns and sorted(tuple(r) for r in cut.collect()) == [("x", 1, text, 5), ("y", 2, "more", 6)]
