"""Packing: whole documents, permitted capacities, no overlap, good filling."""

import re
from collections import defaultdict

import pytest

from activity_engine.llm.packing import CAPACITIES, best_fit, pack

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def check(rows, lengths, capacities):
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        if r.length:
            assert r.capacity in capacities
            by_bin[r.bin_id].append(r)
        by_doc[r.doc_id].append(r)
    assert sorted(by_doc, key=repr) == sorted(lengths, key=repr)
    for d, n in lengths.items():
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == n
    for b in by_bin.values():
        at = 0
        for r in sorted(b, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert {r.capacity for r in b} == {min(c for c in capacities if c >= at)}
    return sum(r.length for r in rows), sum(b[0].capacity for b in by_bin.values())


def test_documents_packed_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lengths = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()}
    tokens, room = check(pack(docs).collect(), lengths, CAPACITIES)
    assert tokens == sum(lengths.values()) and tokens / room > 0.97


def test_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "one two", "c"), (3, "w " * 25, "d"), (4, "v " * 7, None), (5, " \n", "e")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, bin_id string")
    got = pack(docs, capacities=(4, 8), group=3).collect()
    check(got, {1: 0, 2: 0, None: 2, 3: 25, 4: 7, 5: 0}, (4, 8))
    assert all(r.bin_id is None for r in got if not r.length)
    assert pack(spark.createDataFrame([], "doc_id long, text string, piece int")).collect() == []


@pytest.mark.parametrize("lengths, sizes", [([5, 3, 3, 5], [8, 8]), ([4, 4, 4], [4, 8]), ([1], [4]), ([8, 2], [4, 8])])
def test_least_cost_and_downsizing(lengths, sizes):
    assert sorted(best_fit(lengths, (4, 8), 1)[2]) == sizes
