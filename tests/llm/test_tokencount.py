"""Separator scan against the library's own counts and plain splits."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from activity_engine.llm.tokencount import scan, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
END = 49407


def test_documents(spark):
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: len(plain.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    rows = token_counts(docs, PATH, END, shard=200_000, block=1000).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == want and len(rows) == len(want)


def test_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "one two", "c"), (3, "a <|endoftext|> b", "d"), (3, "x", "e"), (3, "x", "e"), (4, "w " * 9000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file string")
    got = sorted(((r.doc_id, r.n_tokens) for r in token_counts(docs, PATH, END, block=64).collect()), key=repr)
    assert [g for g in got if g[0] != 3] == [(1, 0), (2, 0), (4, 9000), (None, 2)]
    assert sorted(n for d, n in got if d == 3)[:2] == [1, 1] and sum(d == 3 for d, _ in got) == 3
    assert token_counts(docs.limit(0), PATH, END).collect() == []


def test_flat_files(spark, tmp_path):
    rng = random.Random(8)
    want = set()
    for i in range(12):
        ids = [rng.choice([5, 6, 9]) if rng.random() < 0.97 else 0 for _ in range(rng.choice([0, 1, 7, 50, 400]))]
        np.array(ids, "<u2").tofile(tmp_path / f"f{i}")
        start, ordinal = 0, 0
        for p, t in enumerate([*ids, None]):
            if t == 0 or t is None and start < len(ids):
                want.add((f"f{i}", ordinal, start, p - start, t == 0))
                start, ordinal = p + 1, ordinal + 1
    names = spark.createDataFrame([(f"f{i}",) for i in range(12)], "file string")
    for block in (1, 7, 1000):
        got = [tuple(r) for r in scan(names, str(tmp_path), 0, block).collect()]
        assert len(got) == len(want) and set(got) == want


def test_torn_file(spark, tmp_path):
    (tmp_path / "torn").write_bytes(b"\x01\x00\x02")
    with pytest.raises(Exception, match="no whole number"):
        scan(spark.createDataFrame([("torn",)], "file string"), str(tmp_path), 0).collect()
