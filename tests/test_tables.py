"""Dictionaries, maps, Bloom-filtered joins, kept states and sketches that are tables."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from activity_engine.operators import bloom as B
from activity_engine.operators import churn as CH
from activity_engine.operators import clean as CL
from activity_engine.operators import codes as CO
from activity_engine.operators import features as FE
from activity_engine.operators import sketches as SK
from activity_engine.operators import states as ST
from tests.events import DAY, T0, events

# ---------------------------------------------------------------- dictionaries


@pytest.fixture()
def many_ranges(spark):
    """Sixteen ranges that adaptive execution leaves apart."""
    keys = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_a_million_values_get_dense_ordered_codes(spark, many_ranges):
    wide = spark.range(1_000_000).select(F.format_string("v%07d", "id").alias("v"), (F.col("id") % 7).alias("w"))
    codes = CO.build_codes(wide, ["v", "w"])
    assert codes.filter("column = 'v' AND code != int(substring(value, 2))").isEmpty()
    assert codes.groupBy("column").agg(F.count("code"), F.max("code")).orderBy("column").collect() == [("v", 1_000_000, 999_999), ("w", 7, 6)]
    assert codes.filter("column = 'w'").orderBy("code").select("value", "n").first() == ("0", 142858)
    # what is broadcast: a row for each range and column
    plan = codes._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SinglePartition" not in plan


@pytest.mark.parametrize("order,indexer", [("alphabet", "alphabetAsc"), ("frequency", "frequencyDesc")])
def test_codes_are_those_of_a_fitted_indexer(spark, many_ranges, order, indexer):
    rng = random.Random(3)
    rows = [(rng.choice(["", " ", "a", "B", "b", "ä", "z,z", "é", *[f"k{i}" for i in range(40)], None]), rng.choice("xyz")) for _ in range(500)]
    df = spark.createDataFrame(rows, "p string, q string")
    model = StringIndexer(inputCols=["p", "q"], outputCols=["pi", "qi"], stringOrderType=indexer).fit(df.dropna())
    got = {(r.column, r.code): r.value for r in CO.build_codes(df, ["p", "q"], order).collect()}
    assert got == {(c, i): v for c, labels in zip(["p", "q"], model.labelsArray) for i, v in enumerate(labels)}


@pytest.mark.parametrize("salts", [1, 4])
def test_encode_keeps_every_row_and_treats_unseen_as_asked(spark, salts):
    codes = CO.build_codes(spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "p string, q int"), ["p", "q"], "frequency")
    rows = [("a", 2), ("zz", None), (None, 1)] + [("b", 9)] * 300  # one value holds most rows, all alike
    df = spark.createDataFrame(rows, "p string, q int")
    out = CO.encode(df, codes, {"p": "pc", "q": "qc"}, salts=salts)
    assert out.columns == ["p", "q", "pc", "qc"]
    assert sorted(map(repr, out.collect())) == sorted(
        repr(r) for r in spark.createDataFrame([("a", 2, 1, 1), ("zz", None, None, None), (None, 1, None, 0)] + [("b", 9, 0, None)] * 300, "p string, q int, pc bigint, qc bigint").collect()
    )
    kept = CO.encode(df, codes, {"p": "pc"}, unseen="keep", salts=salts)
    assert {(r.p, r.pc) for r in kept.collect()} == {("a", 1), ("b", 0), ("zz", 2), (None, None)}
    with pytest.raises(PySparkException, match="no code for p: zz"):
        CO.encode(df, codes, {"p": "pc"}, unseen="error", salts=salts).collect()


def test_encode_with_empty_tables_and_clashing_columns(spark):
    df = spark.createDataFrame([("a", 1)], "`p` string, `p code` int")
    none = CO.build_codes(df.limit(0), ["p"])
    assert none.count() == 0
    assert CO.encode(df, none, {"p": "c"}).collect() == [("a", 1, None)]
    assert CO.encode(df, none, {"p": "c"}, unseen="keep").collect() == [("a", 1, 0)]
    assert CO.encode(df.limit(0), CO.build_codes(df, ["p", "p code"]), {"p": "c", "p code": "d"}).count() == 0
    with pytest.raises(ValueError, match="are there already"):
        CO.encode(df, none, {"p": "p code"})
    with pytest.raises(ValueError, match="used by the encoding"):
        CO.encode(df.withColumn("_c_code", F.lit(1)), none, {"p": "c"})
    with pytest.raises(ValueError):
        CO.build_codes(df, ["p"], "random")


# ---------------------------------------------------------------- maps by a table


def test_map_by_a_table(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4), ("b", 2)], "k string, v int")
    pairs = spark.createDataFrame([("a", "A"), ("b", None), ("unused", "U"), (None, "N")], "key string, value string")
    out = CL.map_values_from(df, "k", pairs)
    assert out.columns == ["k", "v"]
    assert sorted(out.collect(), key=str) == sorted([("A", 1), (None, 2), ("c", 3), (None, 4), (None, 2)], key=str)
    assert CL.map_values_from(df, "k", pairs.limit(0)).count() == 5
    assert CL.map_values_from(df.limit(0), "k", pairs).count() == 0
    numbers = CL.map_values_from(df, "v", spark.createDataFrame([("1", 10)], "f string, t bigint"), "f", "t")
    assert numbers.schema["v"].dataType.simpleString() == "int" and {r.v for r in numbers.collect()} == {10, 2, 3, 4}


def test_map_with_a_key_twice_ends_the_job(spark):
    df = spark.createDataFrame([("a",)], "k string")
    twice = spark.createDataFrame([("a", "x"), ("a", "x")], "key string, value string")
    with pytest.raises(PySparkException, match="mapping of k has a key twice: a"):
        CL.map_values_from(df, "k", twice).collect()
    with pytest.raises(ValueError):
        CL.map_values_from(df.withColumn("_map_hit", F.lit(1)), "k", twice)


# ---------------------------------------------------------------- Bloom filter


def test_filtered_semi_join_is_the_semi_join(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(None if rng.random() < 0.05 else f"u{rng.randrange(400)}", i, i) for i in range(3000)] + [("u1", 0, 0)] * 1500
    df = spark.createDataFrame(rows, "userId string, _word int, _bits int")  # names the filter uses too
    keys = spark.createDataFrame([(f"u{i % 60}",) for i in range(200)] + [(None,), ("absent",)], "userId string")
    want = sorted(df.join(keys, "userId", "left_semi").collect())
    assert sorted(B.filtered_semi_join(df, keys, "userId").collect()) == want
    monkeypatch.setattr(B, "MAX_WORDS", 1)  # a filter that lets nearly everything through
    assert sorted(B.filtered_semi_join(df, keys, "userId").collect()) == want
    assert B.filtered_semi_join(df, keys.limit(0), "userId").count() == 0
    assert B.filtered_semi_join(df.limit(0), keys, "userId").count() == 0


def test_few_rows_of_other_keys_pass_the_filter(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("u"), "id").alias("userId"))
    words = 20_000 // B.KEYS_A_WORD
    bits = B.build_filter(keys, "userId", words)
    assert bits.count() <= words
    others = spark.range(20_000, 420_000).select(F.concat(F.lit("u"), "id").alias("userId"))
    assert B.prefilter(keys, bits, "userId", words).count() == 20_000
    assert B.prefilter(others, bits, "userId", words).count() < 0.04 * 400_000


def test_events_of_others_end_in_the_scan_stage(spark):
    rows = [dict(userId=f"u{i % 500}", ts=T0 + i, page="Cancellation Confirmation" if i in (3, 4) else "NextSong") for i in range(5000)]
    a = events(spark, *rows)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = CH.events_of_churned_filtered(a)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == CH.events_of_churned(a).count() == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # the exact join shuffles, and below its exchange stands the broadcast filter
    top = plan.index("SortMergeJoin")
    assert top < plan.index("Exchange hashpartitioning(userId") < plan.index("BroadcastHashJoin")


# ---------------------------------------------------------------- kept states


def _log(spark, n=1500):
    rng = random.Random(11)
    pages = ["NextSong", "Thumbs Up", "Thumbs Down", "Add Friend", "Home", "Cancellation Confirmation"]
    rows = [
        dict(
            userId=rng.choice(["", "hot", "hot", f"u{rng.randrange(30)}"]), sessionId=rng.randrange(3), itemInSession=rng.randrange(4),
            ts=T0 + rng.randrange(20) * DAY + rng.randrange(5), page=rng.choice(pages[: 5 + (i % 50 == 0)]), level=rng.choice(["free", "paid"]),
            gender=rng.choice(["M", "F", None]),
        )
        for i in range(n)
    ]
    return events(spark, *rows).withColumn("batch", F.pmod(F.xxhash64("ts", "sessionId", "page"), F.lit(3)))


def test_states_of_batches_give_the_features_of_the_whole_log(spark, tmp_path):
    log = _log(spark).persist()
    a = log.drop("batch")
    want = sorted(FE.behaviour_features(a, "2025-01-01").collect())
    path, packed = str(tmp_path / "days"), str(tmp_path / "packed")
    for b in range(3):  # every batch has events of all days
        ST.write_states(log.filter(F.col("batch") == b).drop("batch"), path, f"b{b}")
    ST.write_states(log.filter(F.col("batch") == 1).drop("batch"), path, "b1")  # a batch written again
    ST.write_states(a.limit(0), path, "empty")
    assert sorted(ST.behaviour_of_states(spark, path, "2025-01-01").collect()) == want and len(want) > 10
    ST.compact_states(spark, path, packed, "to_b2")
    assert spark.read.parquet(packed).count() == ST.read_states(spark, path).count() < spark.read.parquet(path).count()
    later = sorted(ST.behaviour_of_states(spark, packed, "2025-02-01").collect())
    assert later == sorted(FE.behaviour_features(a, "2025-02-01").collect())
    silent = ST.behaviour_of_states(spark, packed, "2025-01-01", keep_silent=True)
    assert sorted(silent.collect()) == sorted(FE.behaviour_features(a, "2025-01-01", keep_silent=True).collect())
    log.unpersist()


# ---------------------------------------------------------------- sketches


def test_merged_sketches_count_a_user_once_within_the_bound(spark):
    day = F.col("id") % 10
    a = spark.range(400_000).select((F.col("id") % 50_000).cast("string").alias("userId"), F.when(day < 9, day).alias("day"), F.lit("x").alias("level"))
    daily = SK.user_sketches(a, ["day"])
    assert daily.count() == 10  # a null day is a value
    whole = SK.estimated_users(SK.merge_sketches(daily, [])).first().count_users
    assert abs(whole - 50_000) < 4 * SK.relative_error() * 50_000
    for r in SK.estimated_users(daily).collect():
        assert abs(r.count_users - 5_000) < 4 * SK.relative_error() * 5_000
    again = SK.merge_sketches(SK.merge_sketches(daily, [(F.col("day") % 2).alias("odd")]), [])
    assert abs(SK.estimated_users(again).first().count_users - 50_000) < 4 * SK.relative_error() * 50_000


def test_sketches_of_few_null_and_no_users(spark):
    a = spark.createDataFrame([("x", "u"), ("x", "u"), ("x", None), (None, "v"), ("y", None)], "level string, userId string")
    got = {r.level: r.count_users for r in SK.estimated_users(SK.user_sketches(a, ["level"])).collect()}
    assert got == {"x": 1, None: 1, "y": 0}
    assert SK.user_sketches(a.limit(0), ["level"]).count() == 0


# ---------------------------------------------------------------- two grains


def test_play_counts_have_no_expand_and_count_null_as_a_value(spark):
    a = events(
        spark, dict(userId="a", song="s", artist="x"), dict(userId="a", song=None, artist="y"), dict(userId="a", song=None, artist="x"),
        dict(userId="a", song="x", artist=None), dict(userId="b", page="Home"),
    )
    out = FE.play_counts(a)
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.collect() == [("a", 4, 3, 3)]
