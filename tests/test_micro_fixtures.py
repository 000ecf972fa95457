
import math
import statistics

import pytest
from pyspark.sql import functions as F

from activity_engine.functions import exprs as X
from activity_engine.operators import churn as CH
from activity_engine.operators import clean as CL
from activity_engine.operators import crosstab as CT
from activity_engine.operators import features as FE
from activity_engine.operators import profile as PR
from activity_engine.plans.catalog import ORACLES, QUERIES
from tests.conftest import SMALL
from tests.events import DAY, T0, events
from tests.oracle import compare, duck

AS_OF = "2018-12-01"


def test_null_and_blank_user_dropped(spark):
    a = events(spark, {"userId": None}, {"userId": ""}, {"userId": "a"})
    assert [r.userId for r in CL.clean_events(a).collect()] == ["a"]
    q = CL.quality_counts(a).first()
    assert (q.null_user_ids, q.null_session_ids, q.blank_user_ids) == (1, 0, 1)


def test_tie_at_last_ts_gives_one_row_larger_item_wins(spark):
    a = events(spark, {"itemInSession": 1, "level": "paid"}, {"itemInSession": 2, "level": "free"})
    bf = FE.behaviour_features(a, AS_OF).collect()
    assert len(bf) == 1 and bf[0].last_level == "free"
    assert CH.latest_per_user(a).first().itemInSession == 2


def test_null_location_at_last_event_drops_user(spark):
    a = events(spark, {"ts": T0}, {"ts": T0 + 1, "location": None})
    assert FE.behaviour_features(a, AS_OF).count() == 0


def test_user_without_plays_is_absent_unless_kept(spark):
    a = events(spark, {"page": "Home"}, {"page": "Thumbs Up"}, {"page": "Logout"})
    assert FE.behaviour_features(a, AS_OF).count() == 0
    kept = FE.behaviour_features(a, AS_OF, keep_silent=True).first()
    assert kept.avg_songs == 0.0 and kept.thumbs_up == 1 and kept.thumbs_down == 0


def test_user_only_after_day_15_absent_from_month_share(spark):
    a = events(spark, {"ts": T0 + 20 * DAY + 14 * 3_600_000})
    assert FE.share_of_events(a, CL.in_first_half_of_month(), "m").count() == 0
    assert FE.share_of_events(a, CL.after_noon_hour(), "h").first().h == 1.0


def test_location_pieces(spark):
    df = spark.createDataFrame([("Boston",), ("New York-Newark-Jersey City, NY-NJ-PA",)], "location string")
    rows = {
        r.location: r
        for r in df.select(
            "location",
            X.state_code("location").alias("code"),
            X.state_group("location").alias("grp"),
            X.city("location").alias("city"),
        ).collect()
    }
    assert rows["Boston"].code == "Boston" and rows["Boston"].grp is None and rows["Boston"].city == "Boston"
    ny = rows["New York-Newark-Jersey City, NY-NJ-PA"]
    assert (ny.code, ny.grp, ny.city) == ("PA", "NY-NJ-PA", "New York-Newark-Jersey City")


def test_agents(spark):
    df = spark.createDataFrame(
        [(events.__globals__["CHROME"],), ("curl/7",), ("Mozilla/5.0 (compatible; MSIE 9.0; Windows NT 6.1; Trident/5.0)",)],
        "ua string",
    )
    got = [(r.b, r.p) for r in df.select(X.browser("ua").alias("b"), X.platform("ua").alias("p")).collect()]
    assert got == [("Chrome", "Mac"), (None, None), ("IE", "Windows")]


def test_one_play_stddev_null_then_zero_in_training(spark):
    a = events(spark, {"ts": T0 + 13 * 3_600_000}, {"ts": T0 + 14 * 3_600_000, "page": "Home"})
    assert FE.user_length_stats(a).first().stddev_length is None
    t = FE.training_set(a).first()
    assert t.stddev_length == 0.0 and t.total_songs == 1.0


def test_level_changers_zero_for_one_level(spark):
    a = events(spark, {"userId": "x"}, {"userId": "x"}, {"userId": "y", "level": "paid"})
    assert PR.level_changers(a).first().n_users == 0


def test_null_song_counts_as_a_value(spark):
    a = events(spark, {"song": "s1"}, {"song": None})
    assert FE.play_counts(a).first().unique_songs == 2


def test_page_never_seen_is_a_zero_column(spark):
    a = events(spark, {})
    row = FE.page_pivot(a).first()
    assert row["Help"] == 0 and row["NextSong"] == 1 and row["sum_pages"] == 1


def test_flat_class_dropped_from_scaled_crosstab(spark):
    ct = spark.createDataFrame([("a", 0, 5), ("b", 0, 5), ("a", 1, 1), ("b", 1, 3)], "k string, churn int, count long")
    got = sorted((r.k, r.churn, r.scaled) for r in CT.scaled_crosstab(ct, "k").collect())
    assert got == [("a", 1, 0.0), ("b", 1, 1.0)]


def test_epoch_edge_dates_and_weekdays(spark):
    df = spark.createDataFrame([(1538351999999,), (1538352000000,)], "ts long")
    got = [(r.d, r.w) for r in df.select(X.event_date("ts").alias("d"), X.weekday_of("ts").alias("w")).collect()]
    assert got == [("2018-09-30", 0), ("2018-10-01", 1)]


def test_churn_label_is_cancellation_only(spark):
    a = events(
        spark,
        {"userId": "c", "page": "Cancellation Confirmation"},
        {"userId": "d", "page": "Downgrade"},
    )
    got = {r.userId: r.churn for r in CH.churn_labels(a).collect()}
    assert got == {"c": 1, "d": 0}


def _users(spark, counts):
    """Users with a 2-valued dimension: (value, churned, total) per group."""
    parts = [
        spark.range(n).select(F.lit(v).alias("g"), (F.col("id") < x).cast("int").alias("churn")) for v, x, n in counts
    ]
    return parts[0].unionByName(parts[1])


def test_ztest_golden_values(spark):
    z1 = CT.ztest_counts(_users(spark, [("a", 54, 250), ("b", 45, 198)]), "g").first()
    assert round(z1.z, 4) == -0.2856 and round(z1.p_value, 4) == 0.7752
    z2 = CT.ztest_counts(_users(spark, [("a", 33, 130), ("b", 66, 318)]), "g").first()
    assert round(z2.z, 4) == 1.0719 and round(z2.p_value, 4) == 0.2838


def test_histogram_clamps_max_into_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (None,)], "x double")
    got = [(r.bin, r.n) for r in PR.histogram(df, "x", 2).collect()]
    assert got == [(0, 1), (1, 2)]


def test_histogram_has_every_bin(spark):
    df = spark.createDataFrame([(0.0,), (10.0,)], "x double")
    got = [(r.bin, r.bin_start, r.bin_end, r.n) for r in PR.histogram(df, "x", 4).collect()]
    assert got == [(0, 0.0, 2.5, 1), (1, 2.5, 5.0, 0), (2, 5.0, 7.5, 0), (3, 7.5, 10.0, 1)]
    assert PR.histogram(df.filter("x < 0"), "x", 4).collect() == []


def test_scaled_crosstab_keeps_every_class(spark):
    rows = [("a", 0, 1), ("b", 0, 3), ("a", 2, 4), ("b", 2, 8), ("c", 1, 5)]
    ct = spark.createDataFrame(rows, "k string, churn int, count long")
    got = sorted((r.churn, r.k, r.scaled) for r in CT.scaled_crosstab(ct, "k").collect())
    assert got == [(0, "a", 1 / 3), (0, "b", 1.0), (0, "c", 0.0), (1, "a", 0.0), (1, "b", 0.0), (1, "c", 1.0), (2, "a", 0.5), (2, "b", 1.0), (2, "c", 0.0)]
    with pytest.raises(Exception, match="churn outside"):
        CT.scaled_crosstab(ct, "k", classes=[0, 1]).collect()


def test_ztest_needs_two_groups(spark):
    three = _users(spark, [("a", 5, 20), ("b", 6, 20)]).unionByName(_users(spark, [("c", 1, 9), ("c", 0, 1)]))
    for users in (three, three.filter("g = 'a'")):
        with pytest.raises(Exception, match="two values of g"):
            CT.ztest_counts(users, "g").collect()


def test_p_value_against_erfc(spark):
    zs = [0.0, 0.3, 0.66, 0.67, 1.0, 2.5, 5.6, 5.7, 9.0, -1.96]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    got = {r.z: r.p for r in df.select("z", X.two_sided_p("z").alias("p")).collect()}
    for z in zs:
        assert math.isclose(got[z], math.erfc(abs(z) / math.sqrt(2)), rel_tol=1e-12), z


def test_length_by_churn_merges_user_sums(spark):
    a = events(
        spark, {"userId": "x", "length": 1.0}, {"userId": "x", "length": 4.0}, {"userId": "y", "length": 10.0}, {"userId": "z", "length": 3.0},
        {"userId": "z", "page": "Cancellation Confirmation", "length": None},
    )
    got = {r.churn: r for r in CT.length_by_churn(a).collect()}
    assert math.isclose(got[0].mean_length, 5.0) and math.isclose(got[0].stddev_length, statistics.stdev([1, 4, 10]))
    assert got[1].mean_length == 3.0 and got[1].stddev_length is None


def test_dates_do_not_depend_on_the_session_zone(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", "America/New_York")
    df = own.createDataFrame([(1538352000000,), (1538351999999,), (-1,)], "ts long")
    got = [tuple(r) for r in df.select(X.event_date("ts"), X.event_datetime("ts"), X.hour_of("ts"), X.day_of("ts"), X.weekday_of("ts"), X.weekday_name("ts")).collect()]
    assert got == [
        ("2018-10-01", "2018-10-01 00:00:00", 0, 1, 1, "Monday"),
        ("2018-09-30", "2018-09-30 23:59:59", 23, 30, 0, "Sunday"),
        ("1969-12-31", "1969-12-31 23:59:59", 23, 31, 3, "Wednesday"),
    ]
    assert FE.behaviour_features(events(own, {"ts": 1538352000000}), AS_OF).first().days_active == 61


@pytest.mark.parametrize("name", ["event_dates", "time_parts", "behaviour_features", "sql_users_by_level"])
def test_queries_in_a_second_session_with_another_zone(spark, name):
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", "America/New_York")
    ok, msg = compare(QUERIES[name](own, SMALL), duck(SMALL), ORACLES[name])
    assert ok, msg


def test_full_tie_gives_the_same_last_event_everywhere(spark):
    one = {"itemInSession": 1, "level": "free", "location": "Aa, ZZ", "page": "Home"}
    two = {"itemInSession": 1, "level": "paid", "location": "Bb, AA", "page": "NextSong"}
    a = events(spark, one, two, {"ts": T0 - 1, "itemInSession": 0})
    assert FE.behaviour_features(a, AS_OF).first().last_level == "paid"
    assert CH.latest_per_user(a).first().level == "paid"
    assert CH.latest_per_user(a, ["location"], keys=["userId", "gender"]).first().location == "Bb, AA"
    assert CH.last_values(a, ["location", "level"]).first().last_level == "paid"
    assert CT.user_latest_with_churn(a, ["level"]).first().level == "paid"
    assert FE.user_aggregates(a).first().last.level == "paid"


def test_explore_report_tables(spark):
    from activity_engine.plans.report import explore, scaled
    from activity_engine.sources.fixtures import activity

    rep = explore(activity(spark, SMALL))
    assert rep["row_count"].first().n_events == 1000
    assert rep["churn_counts"].count() == 2
    sc = scaled({k: v for k, v in rep.items() if k in ("events_by_churn_hour", "churn_by_state")})
    assert set(sc) == {"scaled_hour", "scaled_state"}
    assert sc["scaled_hour"].filter("scaled < 0 OR scaled > 1").count() == 0


def test_explore_tables_equal_their_operators(spark):
    """Each table derived from the shared cells and users is that of its own operator."""
    import __spark_entry__ as entry
    from activity_engine.plans.report import explore
    from activity_engine.sources.fixtures import activity

    raw = activity(spark, SMALL)
    a = CL.clean_events(raw).persist()
    rep = explore(raw)
    user_dims = {"auth": F.col("auth"), "gender": F.col("gender"), "level": F.col("level"), "city": X.city("location"), "state": X.state_group("location")}
    event_dims = {"page": F.col("page"), "browser": X.browser("userAgent"), "platform": X.platform("userAgent"),
                  "hour": X.hour_of("ts"), "day": X.day_of("ts"), "weekday": X.weekday_of("ts")}
    want = {
        "distinct_users": PR.distinct_count(a, "userId", "unique_users"),
        "distinct_auth": PR.distinct_values(a, "auth").orderBy("auth"),
        "distinct_pages": PR.distinct_values(a, "page").orderBy("page"),
        "events_by_page": PR.events_by(a, ["page"]),
        "level_changers": PR.level_changers(a),
        "length_histogram": PR.histogram(a, "length", 20),
        "top_locations": PR.top_k(PR.users_by(a, ["location"]), "count_users", 5, ["location"]),
        "top_agents": PR.top_k(PR.users_by(a, ["userAgent"]), "count_users", 5, ["userAgent"]),
        "churn_counts": CT.label_balance(CH.churn_labels(a)),
        "length_by_churn": CT.length_by_churn(a),
        "state_rollup": PR.rolled_up_users(a, "location", X.state_group("location"), "state"),
        "browser_rollup": PR.rolled_up_users(a, "userAgent", X.browser("userAgent"), "browser"),
        "platform_rollup": PR.rolled_up_users(a, "userAgent", X.platform("userAgent"), "platform"),
        **{f"users_by_{d}": PR.users_by(a, [d]) for d in ["auth", "gender", "level", "location", "userAgent"]},
        **{f"events_by_{p}": PR.events_by_time(a, p) for p in ["weekday", "day", "hour"]},
        **{f"churn_by_{n}": CT.user_crosstab(a, c, n) for n, c in user_dims.items()},
        **{f"events_by_churn_{n}": CT.event_crosstab(a, c, n) for n, c in event_dims.items()},
        **{f"ztest_{d}": CT.ztest_counts(CT.user_latest_with_churn(a, [d]), d) for d in ["gender", "level"]},
    }
    assert set(rep) == {*want, "quality_counts", "row_count", "profile", "distinct_items"}
    for name, frame in want.items():
        got = rep[name].orderBy(*rep[name].columns[:1]) if name.startswith("distinct_") else rep[name]
        assert got.columns == frame.columns and [f.dataType for f in got.schema] == [f.dataType for f in frame.schema], name
        assert _rounded(got.collect()) == _rounded(frame.collect()), name
    scanning = [n for n, df in rep.items() if "events.parquet" in df._jdf.queryExecution().executedPlan().toString()]
    assert sorted(scanning) == ["distinct_items", "length_histogram", "profile", "quality_counts", "row_count"]
    assert entry.queries()["report"](spark, SMALL).count() > 100
    a.unpersist()


def _rounded(rows):
    return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows]


def test_user_without_evening_events_absent_from_hour_share(spark):
    a = events(spark, {"userId": "x", "ts": T0 + 9 * 3_600_000}, {"userId": "y"})
    got = {r.userId for r in FE.share_of_events(a, CL.after_noon_hour(), "h").collect()}
    assert got == {"y"}
    assert {r.userId for r in FE.numerical_features(a).collect()} == {"y"}
    assert {r.userId for r in FE.numerical_features(a, keep_silent=True).collect()} == {"x", "y"}


def test_map_values_cast_columns_and_row_sum(spark):
    df = spark.createDataFrame([("F", "1", "2"), ("M", "x", "3")], "g string, a string, b string")
    out = CL.cast_columns(CL.map_values(df, "g", {"F": "0", "M": "1"}), {"a": "int", "b": "int"}, safe=True)
    out = CL.row_sum(out.fillna(0), ["a", "b"], "s")
    assert [(r.g, r.a, r.s) for r in out.orderBy("g").collect()] == [("0", 1, 3), ("1", 0, 3)]


def test_requests_df_schema(spark):
    from activity_engine.sources.schema import REQUEST_SCHEMA, requests_df

    df = requests_df(spark, [(1, "male", "10.5", "3.0", "2", "1", "0", "2018-08-19", "paid", "CA")])
    assert df.schema == REQUEST_SCHEMA and df.count() == 1


def test_users_by_approx_close_to_exact(spark):
    from activity_engine.sources.fixtures import activity

    a = CL.clean_events(activity(spark, "/root/testdata/sf0.01"))
    exact = {r.location: r.count_users for r in PR.users_by(a, ["location"]).collect()}
    approx = {r.location: r.count_users for r in PR.users_by(a, ["location"], approx=True).collect()}
    assert set(exact) == set(approx)
    assert all(abs(approx[k] - exact[k]) <= max(1, 0.05 * exact[k]) for k in exact)


def test_malformed_lines_go_to_quarantine(spark, tmp_path):
    from activity_engine.operators.clean import clean_events
    from activity_engine.sources.schema import EVENT_SCHEMA, line_counts, read_events_checked

    lines = [
        '{"userId":"a","ts":1538352117000,"page":"NextSong"}', '{"userId":"","ts":1,"page":"Home"}', '{"ts":2,"page":"Help"}',
        '{"userId":"b","ts":', "no json at all", '{"userId":"c","ts":"yesterday"}', "", "   ", '{"userId":"d","unknown":[1,2]}',
    ]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "part.json").write_text("\n".join(lines) + "\n")
    events = read_events_checked(spark, str(tmp_path / "log"), str(tmp_path / "quarantine"))
    assert events.columns == [f.name for f in EVENT_SCHEMA.fields]
    assert sorted(r.userId for r in clean_events(events).collect()) == ["a", "d"]
    held = spark.read.parquet(str(tmp_path / "quarantine"))
    assert {r.value for r in held.collect()} == set(lines[3:6])
    c = line_counts(spark.read.text(str(tmp_path / "log"))).first()
    assert (c.n_lines, c.n_malformed, c.n_null_user, c.n_blank_user, c.n_clean) == (7, 3, 1, 1, 2)
    assert c.n_lines == c.n_clean + c.n_blank_user + c.n_null_user + held.count()
