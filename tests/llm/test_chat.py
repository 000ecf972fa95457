"""Chat formatting: folding of the log, the template, and what is read back."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from activity_engine.llm import chat
from activity_engine.llm.queries import PROBE, QUERIES, chat_log
from tests.conftest import SMALL

LOG = "conv_id long, seq long, kind string, message string, turn long, role string, text string"


def fold(events):
    """Final messages of a log, event by event."""
    state = {}
    place = {k: i for i, k in enumerate(chat.KINDS)}
    for conv, _, kind, message, turn, role, text in sorted(set(events), key=lambda e: (e[1], place.get(e[2], -1), e[6] or "")):
        held = state.setdefault((conv, message), {"turn": None, "role": "", "text": "", "open": False})
        if kind == "open" and not held["open"]:
            held.update(turn=turn, role=role or "", open=True)
        elif kind == "delta":
            held["text"] += text or ""
        elif kind == "edit":
            held["text"] = text or ""
        elif kind == "regenerate":
            held["text"] = ""
    return {(c, m, h["turn"], h["role"], h["text"]) for (c, m), h in state.items()}


def random_log(rng, conversations, messages):
    events = []
    for conv in range(conversations):
        seq = 0
        for m in range(messages if conv else messages * 20):
            events.append((conv, seq, "open", str(m), m, rng.choice(["user", "assistant", None, "a>b<&"]), None))
            for _ in range(rng.randint(0, 12)):
                seq += rng.randint(1, 3)
                kind = rng.choices(["delta", "edit", "regenerate", "noise"], [8, 1, 1, 1])[0]
                text = rng.choice(["a ", "</turn>\n", "<turn user>", "&lt;", "&amp;", "é😀", None, "", "\\"])
                events.append((conv, seq, kind, str(m), None, None, text))
            seq += 1
    rng.shuffle(events)
    return events + rng.sample(events, len(events) // 5)  # some delivered again


@pytest.mark.parametrize("seed", range(3))
def test_fold_equals_events_applied_one_by_one(spark, seed):
    events = random_log(random.Random(seed), 6, 5)
    got = chat.final_messages(spark.createDataFrame(events, LOG))
    assert got.columns == ["conv_id", "message", "turn", "role", "text"]
    rows = got.collect()
    assert {tuple(r) for r in rows} == fold(events) and len(rows) == len(fold(events))


@pytest.mark.parametrize("turns", [1, 4, 64])
def test_format_and_read_back(spark, turns):
    events = random_log(random.Random(9), 5, 7)
    final = {}
    for conv, message, turn, role, text in fold(events):
        final.setdefault(conv, []).append((turn, message, role, text))
    parts = chat.format_log(spark.createDataFrame(events, LOG), turns)
    read = parts.withColumns({"turns": chat.read_turns(F.col("formatted")), "masked": chat.read_loss(F.col("formatted"), F.col("loss"))})
    by = {}
    for r in sorted(read.collect(), key=lambda r: (r.conv_id, r.part)):
        assert r.n_turns == len(r.turns) and r.formatted.count("</turn>\n") == r.n_turns == r.formatted.count("<turn ")
        by.setdefault(r.conv_id, []).append(r)
        assert [r.formatted[s.start : s.start + s.length] for s in r.loss] == [t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") for t in r.masked]
    for conv, messages in final.items():
        want = [(role, text) for _, _, role, text in sorted(messages)]
        assert [(t.role, t.text) for r in by[conv] for t in r.turns] == want
        assert [t for r in by[conv] for t in r.masked] == [text for role, text in want if role == "assistant"]
    assert max(r.n_turns for rows in by.values() for r in rows) <= turns


def test_the_probe_conversation_and_the_stand_in_log(spark):
    rows = {r.conv_id: r for r in QUERIES["op11_chat_format"](spark, SMALL).collect()}
    probe = rows[-7]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert (probe.n_turns, probe.loss_chars, probe.loss_sha256) == (2, len(PROBE), sha(PROBE))
    assert probe.turns_sha256 == sha(f"user\n{PROBE}\nassistant\n{PROBE}\n")
    kinds = {r.kind: r.n for r in chat_log(spark.read.parquet(f"{SMALL}/conversations.parquet")).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds["edit"] > 5 and kinds["regenerate"] > 5 and kinds["delta"] > kinds["open"]


def test_native_plan(spark):
    plan = QUERIES["op11_chat_format"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop", "Window"))


def test_nulls_ties_repeats_empty_and_extra_columns(spark):
    turns = [(None, 0, "user", "a"), (None, 1, "assistant", None), (1, None, None, None), (1, 5, "assistant", "x" * 300_000), (1, 5, "user", ""), (1, 5, "user", "")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    parts = chat.format_log(chat_log(table))
    got = {r.conv_id: r for r in chat.digest(parts).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[None].turns_sha256 == sha("user\na\nassistant\n\n") and got[None].loss_chars == 0
    assert got[1].n_turns == 3 and got[1].loss_sha256 == sha("x" * 300_000)  # the row given twice is one message
    assert got[1].turns_sha256 == sha("\n\n" + "assistant\n" + "x" * 300_000 + "\nuser\n\n")
    clash = chat_log(table).withColumns({c: F.lit("z") for c in ("order", "start", "pieces", "opened", "part", "head", "body", "turns", "loss")})
    assert {r.conv_id: r for r in chat.digest(chat.format_log(clash)).collect()} == got
    assert chat.format_log(chat_log(table.limit(0))).collect() == []
    unopened = spark.createDataFrame([(1, 3, "delta", "m", None, None, "b"), (1, 3, "delta", "m", None, None, "a"), (1, 9, None, "m", None, None, "c")], LOG)
    assert [(r.turn, r.role, r.text) for r in chat.final_messages(unopened).collect()] == [(None, "", "ab")]
