"""Nearest neighbours against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from activity_engine.llm import ann


def brute(rows, k, every):
    good = [(i, tuple(map(float, v))) for i, v in rows if i is not None and v is not None and None not in v and all(map(math.isfinite, v)) and any(v)]
    out = []
    for q, x in sorted({i: min((v for j, v in good if j == i), key=lambda v: np.array(v).tobytes()) for i, _ in good}.items()):
        if q % every:
            continue
        s = sorted((-math.fsum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in good if i != q and len(x) == len(y))
        out += [(q, r + 1, i, -d) for r, (d, i) in enumerate(s[:k])]
    return out


def result(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    assert result(ann.nearest(table, F.col("vec_id") % 20 == 0)) == brute(rows, 20, 20)


def test_many_tiles_and_copies(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    monkeypatch.setattr(ann, "CANDIDATE_BLOCK", 50)
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(150)] + [(200 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert result(ann.nearest(df, F.col("vec_id") % 3 == 0, 5)) == brute(rows, 5, 3)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [1.0, 1.0]), (6, []),
        (7, [3.0, 1.0]), (8, [-1.0, 1.0]), (8, [-1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (10, [1.0, 2.0]), (11, [1e-300, 1e300]),
    ]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "vec_id long, embedding array<double>, score string")
    assert result(ann.nearest(df, F.lit(True), 20)) == brute(rows, 20, 1)
    assert ann.nearest(df.limit(0), F.lit(True)).collect() == []


def test_very_large_components(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e160, -1e160]), (2, [1e154, 1e154]), (3, [-1e308, 1e308]), (4, [1e308, 1e308]), (5, [1.0, 2.0]), (20, [1.7e308, 1.7e308])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=3).collect()
    by = {q: [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 20)}
    assert [v for v, _ in by[0]] == [2, 4, 20] and all(s == float("inf") for _, s in by[0])
    assert by[20][0] == (0, float("inf")) and len(by[20]) == 3
