"""The bitmap filter: size, no false negatives, and its life."""

import os

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from activity_engine.llm import bitmap
from activity_engine.session import Scratch
from tests.conftest import SMALL


def test_size_follows_the_number_of_keys_up_to_the_bound():
    assert bitmap.bits_for(0) == bitmap.LEAST_BITS and bitmap.bits_for(1 << 20) == 26
    assert bitmap.bits_for(1 << 40) == bitmap.MOST_BITS and bitmap.bits_for(1 << 40, 20) == 20
    assert bitmap.bits_for(10, 8) == 8


def test_holds_all_keys_and_few_others_and_goes_with_the_scratch_block(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("k"))
    own = np.array([r.k for r in keys.collect()], dtype=np.int64)
    other = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 20_000, dtype=np.int64)
    with Scratch(spark, "bitmap") as scratch:
        held = bitmap.build(keys.unionByName(spark.range(1).select(F.lit(None).cast("long").alias("k"))), "k", scratch)
        small = bitmap.build(keys, "k", scratch, 6)
        assert bitmap.contains(held.value, own).all() and bitmap.contains(held.value, other).mean() < 0.01
        assert len(small.value) == 1 and bitmap.contains(small.value, own).all()
        paths = [held._path, small._path]
        assert all(map(os.path.exists, paths))
    assert not any(map(os.path.exists, paths))


def test_pipeline_leaves_no_broadcast_files(spark, monkeypatch):
    """Two runs leave no more local files of broadcasts than one."""
    made = []
    build = bitmap.build
    monkeypatch.setattr(bitmap, "build", lambda *a, **k: made.append(build(*a, **k)) or made[-1])
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _ in range(2):
        for _, stage in corpus_pipeline.STAGES[1:4]:
            stage(spark, docs, SMALL)
    assert len(made) > 6 and not any(os.path.exists(b._path) for b in made)
