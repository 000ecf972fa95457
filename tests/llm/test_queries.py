"""Registered queries against their SQL, and the pipeline end to end."""

import re

import pytest

import corpus_pipeline
from activity_engine.llm.queries import ORACLES, QUERIES
from tests.conftest import SMALL
from tests.oracle import compare

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", list(ORACLES))
def test_matches_sql(spark, con, name):
    ok, msg = compare(QUERIES[name](spark, SMALL), con, ORACLES[name])
    assert ok, msg


def test_one_query_for_each_operator():
    assert [int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES] == list(range(1, 14))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, SMALL)
        assert rows.columns == docs.columns, name
        after = {r.doc_id: r for r in rows.collect()}
        assert set(after) <= set(before) and len(after) > 0.5 * len(before), name
        if name != "substring_dedup":
            assert all(after[d] == before[d] for d in after), name
        else:
            assert set(after) == set(before) and all(len(r.text) <= len(before[d].text) and r.n_chars == len(r.text) for d, r in after.items())
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, SMALL).collect()
    words = {}
    for r in packed:
        words[r.doc_id] = words.get(r.doc_id, 0) + r.length
    assert words == {d: len(WORD.findall(r.text or "")) for d, r in before.items()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).select("doc_id", "piece", "start", "length").collect())) == sorted(
        (r.doc_id, r.piece, r.start, r.length) for r in packed
    )


def test_pipeline_on_an_empty_table(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
