"""Token files: exact round trip, rank and select, and the library's own ids."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from activity_engine.llm import tokens
from activity_engine.llm.wavelet import WaveletMatrix, read_digest, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def brute(rows):
    out, at = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*ids_of(t), 2]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def result(spark, docs, tmp_path, **more):
    manifest = write_tokens(docs, str(tmp_path / "files"), PATH, **more)
    manifest.write.parquet(str(tmp_path / "manifest"))
    got = read_digest(spark.read.parquet(str(tmp_path / "manifest"))).collect()
    return [tuple(r) for r in sorted(got, key=lambda r: r.start)]


def test_documents(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert result(spark, docs, tmp_path, shard=100_000) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_edge_rows(spark, tmp_path):
    rows = [
        (3, None, "a"), (None, "Hello, WORLD it's 2024!", "b"), (1, "", "c"), (2, " \n\t", "d"), (2, "twice", "e"), (2, "twice", "e"),
        (9, "naïve ÉCOLE straße ×÷ é  x <|endoftext|> <|ENDOFTEXT|> 日本語 🙂 a\x00b", None), (5, "word " * 50000, "f"), (6, "x" * 5000, "g"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string")
    assert result(spark, docs, tmp_path) == brute([r[:2] for r in rows])
    assert result(spark, docs.limit(0), tmp_path / "none") == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(), st.text(alphabet="aBc éÉ'19.,!<|> \ń ßİ×")), max_size=4))
def test_units_give_the_library_ids(texts):
    ids, count = tokens.encoder(PATH).encode(pa.array(texts, pa.string()))
    at = np.concatenate([[0], np.cumsum(count)])
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [ids_of(t) for t in texts]


@pytest.mark.parametrize("bits, n", [(1, 0), (3, 1), (5, 700), (16, 5000), (17, 3000)])
def test_rank_select_access(bits, n):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, min(1 << bits, 1 << bits), n) if bits < 16 else rng.choice([0, 7, 40_000, (1 << bits) - 1], n)
    m = WaveletMatrix.from_bytes(WaveletMatrix.build(ids, bits, {"a": 1}).to_bytes())
    assert m.meta == {"a": 1} and m.decode().tolist() == ids.tolist()
    for i in rng.integers(0, n, 50) if n else []:
        assert m.access(int(i)) == ids[i]
    for t in [*ids[:5].tolist(), 1]:
        places = np.flatnonzero(ids == t).tolist()
        assert m.count(t) == len(places)
        assert m.count(t, n // 2) == int((ids[: n // 2] == t).sum())
        assert [m.occurrence(t, k) for k in range(min(len(places), 20))] == places[:20]
    with pytest.raises(IndexError):
        m.occurrence(1 << bits, 0)
    with pytest.raises(ValueError):
        WaveletMatrix.build(np.array([1 << bits]), bits)


def test_lookups_inflate_a_chunk_a_plane(tmp_path):
    ids = np.random.default_rng(4).integers(0, 1 << 16, 300_000)
    path = str(tmp_path / "big.wvm")
    blob = WaveletMatrix.build(ids, 16, {"doc_id": [1]}).to_bytes()
    with open(path, "wb") as out:
        out.write(blob)
    m = WaveletMatrix.open(path)
    read, source = [], m._source
    m._source = lambda offset, n: read.append(n) or source(offset, n)
    assert m.access(123_456) == ids[123_456]
    assert sum(read) < len(blob) / 3 and len(read) <= 2 * 16
    token = int(ids[77])
    assert m.count(token) == (ids == token).sum() and [m.occurrence(token, k) for k in range(m.count(token))] == np.flatnonzero(ids == token).tolist()
    assert np.array_equal(m.decode(), ids)


def test_files_are_read_by_several_tasks_and_looked_up_over_all(spark, tmp_path):
    from activity_engine.llm import wavelet

    docs = spark.createDataFrame([(i, f"the cat {i} sat on the mat " * (1 + i % 7)) for i in range(200)], "doc_id long, text string").repartition(3)
    files = wavelet.write_tokens(docs, str(tmp_path / "files"), PATH, shard=300).persist()
    n = files.count()
    assert n > 12
    assert wavelet.read_digest(files).rdd.getNumPartitions() > 1
    assert wavelet.read_digest(files, task_ids=300).rdd.getNumPartitions() > 4
    placed = sorted((r.before, r.path) for r in wavelet._placed(files).collect())
    flat = np.concatenate([WaveletMatrix.open(p).decode() for _, p in placed]).astype(np.int64)
    tokens = [int(t) for t in (flat[0], flat[4], 2, 40_000)]
    assert {r.token: r.n for r in wavelet.count_tokens(files, tokens).collect()} == {t: int((flat == t).sum()) for t in tokens}
    found = wavelet.locate_tokens(files, [*tokens, tokens[0]]).collect()
    assert sorted((r.token, r.position) for r in found) == sorted((t, int(i)) for t in tokens for i in np.flatnonzero(flat == t))
    starts = {r.doc_id: r.start for r in wavelet.read_digest(files).collect()}
    assert all(starts[r.doc_id] + r.place == r.position for r in found)
    empty = wavelet.write_tokens(docs.limit(0), str(tmp_path / "none"), PATH)
    assert wavelet.locate_tokens(empty, tokens).collect() == [] and wavelet.read_digest(empty).collect() == []
