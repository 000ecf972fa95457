"""ML invariants: metrics agree with Spark's evaluator, splits, grids, -1 rule."""

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from activity_engine.plans import ml as ML
from activity_engine.plans import score as SC
from activity_engine.plans.catalog import QUERIES, batch_features, rule_predictions
from tests.conftest import SMALL


def test_evaluate_matches_spark_evaluator(spark):
    pred = spark.range(200).select(
        (F.col("id") % 3 == 0).cast("double").alias("label"),
        ((F.col("id") % 5 == 0) | (F.col("id") % 7 == 0)).cast("double").alias("prediction"),
    )
    m = ML.evaluate(pred).first()
    for metric, ours in [("f1", m.weighted_f1), ("accuracy", m.accuracy), ("weightedPrecision", m.weighted_precision), ("weightedRecall", m.weighted_recall)]:
        ref = MulticlassClassificationEvaluator(metricName=metric).evaluate(pred)
        assert round(ours, 12) == round(ref, 12), metric


def test_hash_split_disjoint_and_complete(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("userId"))
    parts = ML.hash_split(df, [0.6, 0.2, 0.2], 42)
    sizes = [p.count() for p in parts]
    assert sum(sizes) == 1000
    assert parts[0].join(parts[1], "userId").count() == 0
    assert 500 < sizes[0] < 700


def test_grid_on_foreign_param_raises(spark):
    svm = ML.train_svm()
    with pytest.raises(ValueError):
        ML.param_grid(svm, {"numTrees": [5]})
    assert len(ML.param_grid(svm, {"maxIter": [50, 100, 150], "regParam": [0.0, 0.01]})) == 6


def test_l1_rows_sum_to_one(spark):
    feats = ML.l1_features(batch_features(spark, SMALL))
    sums = ML.nonzero_entries(feats, "features").groupBy("userId").agg(F.sum(F.abs("value")).alias("s"))
    assert sums.filter(F.abs(F.col("s") - 1.0) > 1e-9).count() == 0


def test_unseen_category_scores_minus_one(spark):
    bf = batch_features(spark, SMALL)
    model, report = ML.build_churn_model(bf, seed=1, num_trees=5)
    assert {r.split for r in report.collect()} == {"train", "test", "validation"}
    req = SC.requests_from_features(bf, "2025-01-01").limit(3)
    bad = req.withColumn("level", F.lit("zzz")).withColumn("request_id", F.xxhash64("request_id"))
    out = {r.request_id: r.outcome for r in SC.score_requests(model, req.unionByName(bad), "2025-01-01").collect()}
    assert len(out) == 6
    bad_ids = {r.request_id for r in bad.collect()}
    assert all(out[i] == -1 for i in bad_ids)
    assert all(out[i] in (0, 1) for i in set(out) - bad_ids)


def test_rule_predictions_metric_query_runs(spark):
    m = ML.evaluate(rule_predictions(batch_features(spark, SMALL))).first()
    assert m.n == 13 and 0.0 <= m.weighted_f1 <= 1.0


@pytest.mark.parametrize("name", ["model_logistic", "score_stream"])
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_random_split_complete(spark):
    df = spark.range(500)
    parts = ML.random_split(df, [0.8, 0.2], 0)
    assert sum(p.count() for p in parts) == 500


def test_model_job_from_json_log(spark, tmp_path):
    from activity_engine.jobs import build_model_job
    from activity_engine.sources.fixtures import activity
    from activity_engine.sources.schema import load_model

    src, dst = str(tmp_path / "events"), str(tmp_path / "model")
    activity(spark, SMALL).write.json(src)
    report = {r.split: r for r in build_model_job(spark, src, dst, "2025-01-01", num_trees=5).collect()}
    assert {"train"} <= set(report) <= {"train", "test", "validation"}  # a split of 13 users may be empty
    # rows with a category that the training rows lack are skipped (M-1); all others are in the report
    rows = [r.asDict() for r in batch_features(spark, SMALL).withColumn("part", ML.hash_split_column([0.6, 0.2, 0.2], 42)).collect()]
    assert len(rows) == 13
    known = {c: {r[c] for r in rows if r["part"] == 0} for c in ML.BATCH_CATEGORICAL}
    assert sum(r.n for r in report.values()) == sum(all(r[c] in known[c] for c in known) for r in rows)
    assert set(SC.known_categories(load_model(dst))) == {"gender", "last_level", "last_state"}


def test_stream_restart_scores_only_new_files(spark, tmp_path):
    from activity_engine.streaming.scoring import start_scoring

    bf = batch_features(spark, SMALL)
    model, _ = ML.build_churn_model(bf, seed=3, num_trees=5)
    req = SC.requests_from_features(bf, "2025-01-01")
    src, sink, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    req.limit(5).write.parquet(src + "/batch1")
    start_scoring(model, spark, src + "/*", sink, ckpt, "2025-01-01", available_now=True).awaitTermination()
    first = spark.read.parquet(sink).count()
    req.write.parquet(src + "/batch2")
    start_scoring(model, spark, src + "/*", sink, ckpt, "2025-01-01", available_now=True).awaitTermination()
    assert first == 5
    assert spark.read.parquet(sink).count() == 5 + req.count()


def test_comparison_fits_shared_points_once(spark, monkeypatch):
    """An untuned model that is a point of the tuned grid is fitted once, with one value."""
    rows = [(str(i), float(i % 3 == 0), [float(i % 7), float(i % 3)]) for i in range(60)]
    data = spark.createDataFrame(rows, "userId string, label double, v array<double>")
    from pyspark.ml.functions import array_to_vector

    data = data.select("userId", "label", array_to_vector("v").alias("features"))
    specs = {
        "plain": (lambda: ML.train_forest(seed=42, num_trees=3, max_depth=2), 3, None),
        "tuned": (lambda: ML.train_forest(seed=42), 3, {"maxDepth": [2, 3], "numTrees": [3]}),
    }
    monkeypatch.setattr(ML, "MODEL_SPECS", specs)
    store = ML.fit_store(data)
    store.run([ML.spec_points(n) for n in specs])
    assert len(store.f1) == 2 * 3
    got = {r.model: r for r in ML.compare_models(data, data).collect()}
    assert set(got) == {"plain", "tuned"} and got["tuned"].cv_f1 >= got["plain"].cv_f1
    grid = {r.params: r.avg_f1 for r in ML.cv_metrics(spark, store, "t", specs["tuned"][0](), 3, specs["tuned"][2]).collect()}
    assert grid["maxDepth=2, numTrees=3"] == got["plain"].cv_f1
    # the metric of a fold, computed apart
    folds = data.withColumn("f", ML.hash_split_column([1.0] * 3, 42))
    f1 = [ML.evaluate(specs["plain"][0]().fit(folds.filter(F.col("f") != i).select("label", "features")).transform(folds.filter(F.col("f") == i))).first().weighted_f1 for i in range(3)]
    assert abs(sum(f1) / 3 - got["plain"].cv_f1) < 0.1


def labelled_rows(spark, n=1500, width=6):
    from pyspark.ml.functions import array_to_vector

    u = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000.0
    label = (u(0) + u(1) * u(2) + u(99) / 2 > 0.9).cast("double")
    return spark.range(0, n, 1, 1).select(F.col("id").cast("string").alias("userId"), label.alias("label"), array_to_vector(F.array(*map(u, range(width)))).alias("features"))


@pytest.mark.parametrize("trees", [2, 5])
def test_cut_forest_is_the_shallower_fit(spark, trees):
    """A deep forest cut at a depth predicts what a fit of that depth does, row counts and F1."""
    data = labelled_rows(spark).persist()
    train, held_out = ML.hash_split(data, [0.7, 0.3], 5)
    depths = [0, 1, 3, 5, 7]
    cut = ML.confusion_by_depth(ML.train_forest(num_trees=trees, max_depth=7).fit(train), held_out, depths)
    for depth in depths:
        pred = ML.train_forest(num_trees=trees, max_depth=depth).fit(train).transform(held_out)
        own = [(r.label, r.prediction, r["count"]) for r in pred.groupBy("label", "prediction").count().collect()]
        assert sorted(cut[depth]) == sorted(own), depth
        assert abs(ML.weighted_f1(own) - ML.f1_evaluator().evaluate(pred)) < 1e-12
    assert len({tuple(sorted(c)) for c in cut.values()}) > 2
    data.unpersist()


def test_grid_of_depths_is_one_fit_a_fold(spark, monkeypatch):
    """Points that differ in depth only cost one fit a fold; all get the F1 of their own fit."""
    fits = []
    fit = ML.RandomForestClassifier.fit
    monkeypatch.setattr(ML.RandomForestClassifier, "fit", lambda self, *a: fits.append(self.getMaxDepth()) or fit(self, *a))
    store = ML.FitStore(labelled_rows(spark), [2])
    points = ML.grid_points(ML.train_forest(), {"maxDepth": [2, 4, 6], "numTrees": [3, 2]})
    got = store.cross_validate(points, 2)
    assert sorted(fits) == [6] * 4
    alone = ML.FitStore(labelled_rows(spark), [2])
    assert got == pytest.approx([alone.cross_validate([p], 2)[0] for p in points], abs=1e-12)


def test_fold_table_has_partitions_by_rows(spark, monkeypatch):
    """Every fit makes tens of passes over the fold table: no more partitions than its rows need."""
    wide = labelled_rows(spark, 4000, 60).repartition(8)
    monkeypatch.setattr(ML, "materialize", lambda df, name: df.repartition(8))
    assert ML.FitStore(wide, [2]).rows.rdd.getNumPartitions() == 1
    monkeypatch.setattr(ML, "ROWS_PER_TASK", 1000)
    store = ML.FitStore(wide, [2])
    assert store.rows.rdd.getNumPartitions() == 4 and store.rows.count() == 4000
