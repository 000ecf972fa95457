"""Sharding against the law it states."""

import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from activity_engine.llm.sharding import rendezvous, shard_table, write_shards


def check(rows, texts, n):
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "key" and 0 <= r.shard < n
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, n)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in rows)
    want = sorted((d is None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts)
    assert got == want


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(5)
    rows = shard_table(docs, [1.0] * 16, 1.0).collect()
    check(rows, [tuple(r) for r in docs.select("doc_id", "text").collect()], 16)
    moved = sum(r.grown_shard != r.shard for r in rows)
    assert 0.02 < moved / len(rows) < 0.11  # 1 / 17 expected
    again = {r.doc_id: r.shard for r in shard_table(docs.orderBy(F.desc("doc_id")), [1.0] * 16).collect()}
    assert again == {r.doc_id: r.shard for r in rows}


def test_weights_and_change(spark):
    ids = spark.range(20000)
    two = ids.select(rendezvous(F.col("id"), [1.0, 3.0]).alias("s")).groupBy("s").count().collect()
    share = {r.s: r["count"] / 20000 for r in two}
    assert abs(share[1] - 0.75) < 0.02
    moved = ids.select(rendezvous(F.col("id"), [1.0, 3.0]).alias("a"), rendezvous(F.col("id"), [1.0, 3.0, 2.0]).alias("b")).filter("a <> b")
    assert {r.b for r in moved.collect()} == {2}
    gone = ids.select(rendezvous(F.col("id"), [1.0, 3.0, 2.0]).alias("a"), rendezvous(F.col("id"), [1.0, 0.0, 2.0]).alias("b")).filter("a <> b")
    assert {r.a for r in gone.collect()} == {1}


def test_edge_rows(spark, tmp_path):
    rows = [(None, "a", 1), (None, None, 2), (1, "", 3), (1, "é x", 4), (1, "é x", 4), (2, "z" * 100000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    check(shard_table(docs, [1.0] * 4, 2.0).collect(), [r[:2] for r in rows], 4)
    assert shard_table(docs.limit(0), [1.0]).collect() == []
    write_shards(docs.drop("shard"), str(tmp_path / "out"), [1.0, 2.0])
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def test_shard_equals_the_choice_computed_apart(spark):
    """The hashes come from the xxhash library, the choice from plain Python."""
    import math

    import xxhash

    weights = [1.0, 2.5, 0.0, 1.0, 4.0]
    ids = spark.range(3000)

    def chosen(key):
        best = (-math.inf, -1)
        for shard, weight in enumerate(weights):
            # Spark hashes the columns one after the other, each seeded with the last
            h = xxhash.xxh64_intdigest(str(key).encode(), seed=42)
            h = xxhash.xxh64_intdigest(shard.to_bytes(4, "little"), seed=h)
            u = ((h >> 12) + 0.5) / 2**52
            if weight > 0:
                best = max(best, (-weight / math.log(u), shard))
        return best[1]

    got = {r.id: r.s for r in ids.select("id", rendezvous(F.col("id"), weights).alias("s")).collect()}
    assert got == {i: chosen(i) for i in range(3000)}


def test_hashes_at_both_ends_give_a_finite_score(spark):
    ends = spark.sql("SELECT explode(array(0L, -1L, 4095L, -4096L)) AS h")
    u = (F.shiftrightunsigned("h", 12).cast("double") + 0.5) / float(1 << 52)
    for r in ends.select(u.alias("u"), (F.lit(-1.0) / F.ln(u)).alias("score")).collect():
        assert 0 < r.u < 1 and 0 < r.score < float("inf")


def test_shard_column_is_never_overwritten(spark, tmp_path):
    import pytest

    df = spark.createDataFrame([(1, 7)], "doc_id long, shard int")
    with pytest.raises(ValueError):
        write_shards(df, str(tmp_path / "a"), [1.0])
    write_shards(df, str(tmp_path / "b"), [1.0], shard="part_of")
    assert spark.read.parquet(str(tmp_path / "b")).select("doc_id", "shard").collect() == [(1, 7)]
