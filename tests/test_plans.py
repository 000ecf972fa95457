"""Plan shape: what must hold for the 100 TB runs, checked on the physical plans."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from activity_engine.operators import churn as CH
from activity_engine.operators import crosstab as CT
from activity_engine.operators import features as FE
from tests.conftest import SMALL
from tests.events import T0, events

# the training-data operators (op*) have their own tests
PLAN_QUERIES = [k for k in entry.oracle_sql() if k not in ("json_event_log", "feature_round_trip") and not k.startswith("op")]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLAN_QUERIES)
def test_no_cartesian_join_and_no_python_in_plan(spark, name):
    p = plan(entry.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name
    assert "EvalPython" not in p and "PythonUDF" not in p, name


def test_behaviour_features_two_user_shuffles_with_partials(spark):
    p = plan(entry.queries()["behaviour_features"](spark, SMALL))
    shuffles = [line for line in p.splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 2, shuffles
    assert "partial_count" in p and "partial_max" in p
    assert "Window [" not in p and "WindowGroupLimit" not in p  # agents in the plan mention Windows


def test_event_scan_is_pruned_and_filtered(spark):
    p = entry.queries()["page_pivot"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in p.splitlines() if "events.parquet" in line][0]
    assert "ReadSchema: struct<user_id:bigint,event_type:string,props:string>" in scan
    assert "PushedFilters: [IsNotNull(user_id)]" in scan


def scans(p: str) -> int:
    return p.count("events.parquet]")


@pytest.mark.parametrize("name", [q for q in PLAN_QUERIES if q.startswith("scaled_") and q != "scaled_features"])
def test_scaled_crosstabs_scan_the_events_once_and_write_nothing(spark, name):
    p = plan(entry.queries()[name](spark, SMALL))
    assert scans(p) == 1, p


@pytest.mark.parametrize("name", ["categorical_features", "training_set"])
def test_frames_that_are_written_scan_the_events_once(spark, name, monkeypatch):
    written = []
    keep = FE.materialize
    monkeypatch.setattr(FE, "materialize", lambda df, table: written.append(plan(df)) or keep(df, table))
    entry.queries()[name](spark, SMALL)
    assert len(written) == 1 and scans(written[0]) == 1
    assert "CartesianProduct" not in written[0] and "EvalPython" not in written[0] and "partial_max" in written[0]


def test_length_by_churn_and_churned_events_do_not_join_events(spark):
    p = plan(entry.queries()["length_by_churn"](spark, SMALL))
    assert scans(p) == 1
    p = plan(entry.queries()["churned_events"](spark, SMALL))
    assert "LeftSemi" in p


def test_scoring_reads_its_input_once(spark):
    from activity_engine.plans import ml as ML
    from activity_engine.plans import score as SC
    from activity_engine.plans.catalog import batch_features

    bf = batch_features(spark, SMALL)
    model, _ = ML.build_churn_model(bf, seed=1, num_trees=3)
    p = plan(SC.score_requests(model, SC.requests_from_features(bf, "2025-01-01"), "2025-01-01"))
    assert scans(p) == 1 and "Union" not in p


def test_crosstab_window_only_after_aggregate(spark):
    p = plan(entry.queries()["events_by_churn_hour"](spark, SMALL))
    lines = p.splitlines()
    w = next(i for i, line in enumerate(lines) if "Window" in line)
    assert any("HashAggregate" in line for line in lines[w + 1:w + 5])


def test_only_fixed_dimensions_are_hinted(spark):
    logical = entry.queries()["clean_events"](spark, SMALL)._jdf.queryExecution().logical().toString()
    assert logical.count("ResolvedHint (strategy=broadcast)") == 2


def test_skewed_user_results_stay_whole(spark):
    """One user holds a third of the rows: results equal a direct count."""
    n = 30_000
    base = events(spark, {})
    rows = (
        spark.range(n)
        .crossJoin(base.drop("userId", "ts", "itemInSession", "page"))
        .select(
            F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 997).cast("string")).alias("userId"),
            "sessionId",
            F.col("id").alias("itemInSession"),
            (F.lit(T0) + F.col("id") * 1000).alias("ts"),
            F.when(F.col("id") % 5 == 0, "Thumbs Up").when(F.col("id") == 7, "Cancellation Confirmation").otherwise("NextSong").alias("page"),
            "auth", "level", "gender", "location", "userAgent", "song", "artist", "length",
        )
    )
    bf = {r.userId: r for r in FE.behaviour_features(rows, "2019-01-01").collect()}
    assert bf["hot"].thumbs_up == rows.filter("userId = 'hot' AND page = 'Thumbs Up'").count()
    assert bf["7"].churn == 1 and bf["hot"].churn == 0
    latest = {r.userId: r.itemInSession for r in CH.latest_per_user(rows).collect()}
    assert latest["hot"] == max(i for i in range(n) if i % 3 == 0)
    ct = {(r.churn, r.page): r["count"] for r in CT.event_crosstab(rows, F.col("page"), "page").collect()}
    assert sum(ct.values()) == n


def test_spreads_on_a_bucketed_table_move_no_events(spark):
    from activity_engine.plans.catalog import clean
    from activity_engine.sources.buckets import spread, write_user_buckets

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = clean(spark, SMALL).select("userId", "ts", "page")
        events = write_user_buckets(rows, "plan_events", 4)
        flagged = spread(events, CH.churn_labels(events))
        assert "Exchange" not in plan(flagged) and "SortMergeJoin" in plan(flagged)
        split = write_user_buckets(rows, "plan_events_split", 4, subs=3)
        spanned = spread(split, CH.user_span(split), 3)
        lines = plan(spanned).splitlines()
        # what moves is the partial aggregate and the per-user rows; the events join where they lie
        moved = [i for i, line in enumerate(lines) if "Exchange" in line]
        assert moved and all(any("Aggregate" in x or "Generate" in x for x in lines[i + 1 : i + 4]) for i in moved)
        assert sorted(map(tuple, spanned.select(*rows.columns, "first_ts").collect())) == sorted(map(tuple, CH.with_user_span(rows).select(*rows.columns, "first_ts").collect()))
        assert split.filter("userId = '1'").select("_sub").distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
