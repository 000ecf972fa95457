"""Toxicity: held-out accuracy, unseen inflections, edge rows."""

import random
import zlib

import numpy as np
import pyarrow as pa

from activity_engine.llm.toxicity import drop_toxic, fit, score
from activity_engine.llm.words import split_words


def corpus(n, seed):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(3, 8))) for _ in range(400)]
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 80))]
        if i % 4 == 0:
            for _ in range(1 + len(words) // 20):
                words[rng.randrange(len(words))] = "zgrub" + "".join(rng.choice("aeiou") for _ in range(3))
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    return texts, np.array(labels)


def test_unseen_inflections_share_vectors():
    texts, labels = corpus(800, 1)
    model = fit(pa.array(texts), labels, 0.25)
    more, truth = corpus(400, 2)
    assert ((model.scores(split_words(pa.array(more), lower=True)) >= 0.5) == truth).mean() > 0.9


def test_documents_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = {r.doc_id: r for r in score(docs, labels).collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    truth = {r.doc_id: r.toxic for r in labels.collect() if rows[r.doc_id].held_out}
    right = sum(rows[d].predicted == t for d, t in truth.items()) / len(truth)
    clean = [d for d, t in truth.items() if not t]
    # some 360 toxic rows to learn from, in four languages
    assert right > 0.93 and sum(rows[d].predicted for d in clean) / len(clean) < 0.03


def test_edge_rows(spark):
    texts, labels = corpus(200, 3)
    rows = [(i, t, "x", 0.5) for i, t in enumerate(texts)] + [(None, "zgrubaei " * 5, "y", 1.0), (900, None, "z", None), (901, "", None, 2.0), (902, texts[0], "x", 0.5), (902, texts[0], "x", 0.5), (903, "zgrubiii " * 30000, "l", 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string, score double")
    marks = spark.createDataFrame([(i, int(t)) for i, t in enumerate(labels)] + [(None, 1), (1, None), (2, 7), (2, 0), (4, 1), (4, 0)], "doc_id long, toxic int")
    got = score(docs, marks).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((d is None, d or 0) for d, *_ in rows)
    by = {r.doc_id: r for r in got}
    assert by[900].score == by[901].score and by[902].score == by[0].score and by[None].held_out
    kept = drop_toxic(docs, marks)
    assert kept.schema == docs.schema
    assert kept.count() == sum(r.predicted == 0 for r in got)
    assert score(docs.limit(0), marks).collect() == []
    assert {r.predicted for r in score(docs, marks.limit(0)).collect()} == {0}
    assert {r.predicted for r in score(docs, marks.filter("toxic = 0")).collect()} == {0}


def test_documents_held_out_recall(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = score(docs, marks).join(marks, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    recall = {k: sum(r.predicted for r in toxic if k in ("all", r.lang)) / sum(k in ("all", r.lang) for r in toxic) for k in ("all", "en", "de", "es", "fr")}
    alarms = sum(r.predicted for r in clean) / len(clean)
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    print(f"accuracy {right:.4f}, false alarms {alarms:.4f}, recall {recall}")
    assert right > 0.93 and alarms < 0.03
    assert recall["all"] > 0.85 and min(recall.values()) > 0.7, recall


def test_labels_without_a_usable_text_take_no_place(spark):
    texts, labels = corpus(400, 4)
    docs = spark.createDataFrame([*enumerate(texts), *((i, None) for i in range(1000, 5000)), *((i, "long " * 5000) for i in range(5000, 6000))], "doc_id long, text string")
    others = spark.range(1000, 2_000_000).selectExpr("id as doc_id", "cast(id % 4 = 0 as int) as toxic")
    marks = spark.createDataFrame([(i, int(t)) for i, t in enumerate(labels)], "doc_id long, toxic int").unionByName(others)
    got = {r.doc_id: r.predicted for r in score(docs, marks).filter("doc_id < 1000 and held_out").collect()}
    assert sum(p == labels[d] for d, p in got.items()) / len(got) > 0.9
