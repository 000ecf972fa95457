"""Stupid backoff against dictionaries of all n-grams."""

import math
import re
from collections import Counter

import pytest

from __spark_entry__ import oracle_sql, queries
from activity_engine.llm.lmscore import BACKOFF, LEAST, lm_scores
from tests.conftest import SMALL
from tests.oracle import compare

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, order):
    split = [WORD.findall((t or "").translate(LOWER)) for _, t in rows]
    count = Counter(tuple(w[i : i + n]) for w in split for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, split))

    def log(context, w):
        if not context:
            return math.log(count[w,] / total)
        if count[*context, w] >= LEAST:
            return math.log(count[*context, w] / count[context])
        return math.log(BACKOFF) + log(context[1:], w)

    return sorted(((d, len(w), sum(log(tuple(w[max(0, i - order + 1) : i]), x) for i, x in enumerate(w))) for (d, _), w in zip(rows, split, strict=True)), key=repr)


def agree(df, want):
    got = sorted(((r.doc_id, r.n_words, r.log_score) for r in df.collect()), key=repr)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-9)


@pytest.mark.parametrize("order", [2, 3])
def test_documents(spark, order):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    agree(lm_scores(docs, order, block_bytes=300_000, range_entries=50_000), brute([tuple(r) for r in docs.select("doc_id", "text").collect()], order))


def test_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "one Two", "c"), (3, "one", "d"), (3, "one", "d"), (4, "w " * 20000, None), (5, "one two\tthree one two", "e"), (6, " \n", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string")
    agree(lm_scores(docs, 2), brute([r[:2] for r in rows], 2))
    assert lm_scores(docs.limit(0)).collect() == []


def test_registered_query_of_order_three(spark, con, tmp_path):
    name = "op2_lm_score_order3"
    ok, msg = compare(queries()[name](spark, SMALL), con, oracle_sql()[name])
    assert ok, msg
    # every pair of words in the last text is common, every three words are not
    texts = ["a b x"] * 5 + ["y b c"] * 5 + ["z c d"] * 5 + ["a b c d"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    score = {q: {r.doc_id: r.log_score for r in queries()[q](spark, str(tmp_path)).collect()} for q in (name, "op2_lm_score")}
    assert score[name][15] == pytest.approx(score["op2_lm_score"][15] + 2 * math.log(BACKOFF), abs=1e-5)
    assert score[name][0] > score["op2_lm_score"][0]
