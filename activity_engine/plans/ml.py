"""Feature transforms, models and evaluation (M-1 .. M-18, C-6, C-7).

All transforms are Spark ML stages (JVM side).  Metrics are computed from a
confusion table (``groupBy(label, prediction).count``: at most classes^2
rows) with DataFrame arithmetic, so nothing per row goes through Python.

Training data is one row per user.  Before any multi-pass fit it is written
to the shared checkpoint folder and read back (``materialize``): that cuts
the lineage to the event scan, so a lost executor costs a re-read of a
small table, not a re-run of the feature job, and every fold and grid point
reads the same rows.
"""

from __future__ import annotations

import functools
import math
import statistics
import uuid
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Normalizer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path, scratch_path
from ..session import materialize as write_once
from ..sources.schema import CATEGORICAL_FEATURES, NUMERICAL_FEATURES, save_model

BATCH_CATEGORICAL = ["gender", "last_level", "last_state"]
BATCH_INDEXED = ["genderIndex", "levelIndex", "stateIndex"]
BATCH_ONE_HOT = ["genderVec", "levelVec", "stateVec"]
BATCH_NUMERIC = ["days_active", "avg_songs", "avg_events", "thumbs_up", "thumbs_down", "addfriend"]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet under the shared checkpoint folder (a fresh
    folder per call) and read it back."""
    return write_once(df, name)


# ---------------------------------------------------------------- transforms


def category_indexer(cols=BATCH_CATEGORICAL, outs=BATCH_INDEXED, invalid: str = "skip") -> StringIndexer:
    """M-1: index by falling frequency (ties alphabetical); unseen values skipped."""
    return StringIndexer(inputCols=cols, outputCols=outs, handleInvalid=invalid, stringOrderType="frequencyDesc")


def one_hot_encoder(cols=BATCH_INDEXED, outs=BATCH_ONE_HOT) -> OneHotEncoder:
    """M-2: one-hot with an extra slot for invalid, the last slot dropped: n slots for n labels."""
    return OneHotEncoder(inputCols=cols, outputCols=outs, handleInvalid="keep", dropLast=True)


def assembler(cols: list[str], out: str) -> VectorAssembler:
    """M-3: assemble columns into one vector."""
    return VectorAssembler(inputCols=cols, outputCol=out)


def l1_normalizer(inp: str = "rawFeatures", out: str = "features") -> Normalizer:
    """M-4: divide each row by its L1 norm."""
    return Normalizer(inputCol=inp, outputCol=out, p=1.0)


def standard_scaler(inp: str, out: str) -> StandardScaler:
    """M-5: subtract the mean, divide by the sample stddev."""
    return StandardScaler(inputCol=inp, outputCol=out, withMean=True, withStd=True)


def index_categories(df: DataFrame, invalid: str = "skip") -> DataFrame:
    """M-1 applied: fit on ``df`` and add the three index columns."""
    return category_indexer(invalid=invalid).fit(df).transform(df)


def one_hot(df: DataFrame) -> DataFrame:
    """M-1 + M-2 applied on a batch feature table (the indexer is fitted once)."""
    indexed = index_categories(df)
    return one_hot_encoder().fit(indexed).transform(indexed)


def batch_feature_stages() -> list:
    """Indexer, encoder, assembler, L1 normaliser of the batch job."""
    return [
        category_indexer(),
        one_hot_encoder(),
        assembler(BATCH_ONE_HOT + BATCH_NUMERIC, "rawFeatures"),
        l1_normalizer(),
    ]


def l1_features(bf: DataFrame) -> DataFrame:
    """M-3 + M-4 on the batch set: ``userId, features`` (L1-normalised vector)."""
    model = Pipeline(stages=batch_feature_stages()).fit(bf)
    return model.transform(bf).select("userId", "features")


def nonzero_entries(df: DataFrame, vec: str, key: str = "userId") -> DataFrame:
    """Vector column as (key, slot, value) rows for non-zero slots."""
    arr = df.select(key, F.posexplode(vector_to_array(vec)).alias("slot", "value"))
    return arr.filter(F.col("value") != 0.0)


def scaled_training_set(t: DataFrame, keep_key: bool = False) -> DataFrame:
    """C-6: ``(label, features)``: 18 numbers standardised, then the 4 codes in
    front.  As in the reference the scaler sees every row (T-17); the model
    job (C-7) fits its transforms on the training split only."""
    num = assembler(NUMERICAL_FEATURES, "numerical_features").transform(t)
    scaled = standard_scaler("numerical_features", "features_scaled").fit(num).transform(num)
    full = assembler(CATEGORICAL_FEATURES + ["features_scaled"], "all_features").transform(scaled)
    cols = [F.col("Churn").cast("double").alias("label"), F.col("all_features").alias("features")]
    return full.select(*(["userId"] if keep_key else []), *cols)


# ---------------------------------------------------------------- splits


def random_split(df: DataFrame, weights: list[float], seed: int) -> list[DataFrame]:
    """M-7: Spark's random split (repeatable for the same input partitioning)."""
    return df.randomSplit(weights, seed=seed)


def hash_split_column(weights: list[float], seed: int, key: str = "userId") -> F.Column:
    """Split number by a hash of the key: repeatable at any partitioning."""
    total = float(sum(weights))
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    bounds = list(functools.reduce(lambda acc, w: acc + [acc[-1] + w / total], weights, [0.0]))[1:-1]
    expr = F.lit(len(weights) - 1)
    for i in reversed(range(len(bounds))):
        expr = F.when(u < bounds[i], F.lit(i)).otherwise(expr)
    return expr


def hash_split(df: DataFrame, weights: list[float], seed: int, key: str = "userId") -> list[DataFrame]:
    """M-7: disjoint, complete splits by key hash."""
    tagged = df.withColumn("_split", hash_split_column(weights, seed, key))
    return [tagged.filter(F.col("_split") == i).drop("_split") for i in range(len(weights))]


# ---------------------------------------------------------------- models


def train_forest(seed: int | None = 42, num_trees: int = 20, max_depth: int = 5, **kw) -> RandomForestClassifier:
    """M-8: random forest (the notebook's: seed 42, depth 5; the job's: 100 trees, gini, sqrt)."""
    return RandomForestClassifier(labelCol="label", featuresCol="features", seed=seed, numTrees=num_trees, maxDepth=max_depth, **kw)


def train_gbt(seed: int = 0) -> GBTClassifier:
    """M-9: gradient-boosted trees, seed 0."""
    return GBTClassifier(labelCol="label", featuresCol="features", seed=seed)


def train_logistic(max_iter: int = 50) -> LogisticRegression:
    """M-10: logistic regression."""
    return LogisticRegression(labelCol="label", featuresCol="features", maxIter=max_iter)


def train_svm(max_iter: int = 100) -> LinearSVC:
    """M-11: linear SVM."""
    return LinearSVC(labelCol="label", featuresCol="features", maxIter=max_iter)


def f1_evaluator() -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", metricName="f1")


def param_grid(estimator, grid: dict[str, list]) -> list:
    """M-15: a grid built on the estimator that will be fitted.

    The reference built its SVM grid on a second estimator object and fitted
    the first (T-13), so the grid never applied.  Params here are looked up
    by name on ``estimator`` itself; a name it does not have raises.
    """
    builder = ParamGridBuilder()
    for name, values in grid.items():
        if not estimator.hasParam(name):
            raise ValueError(f"{type(estimator).__name__} has no param {name!r}")
        builder = builder.addGrid(estimator.getParam(name), values)
    return builder.build()


# Rows of one partition of the table that fits read: below it a fit is one task a
# pass, and the cores are filled by fits beside each other, not by tiny tasks.
ROWS_PER_TASK = 100_000
# What is read of a node in a saved tree.
SAVED_NODE = "struct<id: int, prediction: double, impurityStats: array<double>, leftChild: int, rightChild: int>"


def leaf_shares(nodes: dict[int, Row], depth: int) -> list[list[float]]:
    """What each leaf of a fitted tree votes (class shares) if the tree ends at ``depth``.

    ``nodes`` are the saved nodes of one tree by id (numbered in pre-order, as
    leaves are).  As in a fit, two leaves of one parent that predict the same
    class are one leaf.
    """
    whole: dict[int, float | None] = {}  # node -> class, if it is a leaf of the cut tree

    def close(i: int, level: int) -> float | None:
        n = nodes[i]
        if n.leftChild < 0 or level == depth:
            whole[i] = n.prediction
        else:
            left, right = close(n.leftChild, level + 1), close(n.rightChild, level + 1)
            whole[i] = left if left is not None and left == right else None
        return whole[i]

    shares: list[list[float]] = []

    def walk(i: int, above: list[float] | None) -> None:
        n = nodes[i]
        if above is None and whole[i] is not None:
            total = sum(n.impurityStats)
            above = [c / total if total else 0.0 for c in n.impurityStats]
        if n.leftChild < 0:
            shares.append(above)
        else:
            walk(n.leftChild, above)
            walk(n.rightChild, above)

    close(0, 0)
    walk(0, None)
    return shares


def forest_shares(model, depths: list[int]) -> dict[int, list[list[list[float]]]]:
    """``leaf_shares`` of every tree of a fitted forest at each depth, from its saved
    nodes (at most trees x 2^(depth + 1) rows)."""
    spark = SparkSession.active()
    path = scratch_path(spark, f"forest/{uuid.uuid4().hex}")
    model.save(path)
    trees: dict[int, dict[int, Row]] = {}
    for r in spark.read.schema(f"treeID int, nodeData {SAVED_NODE}").parquet(f"{path}/data").select("treeID", "nodeData.*").collect():
        trees.setdefault(r.treeID, {})[r.id] = r
    delete_path(spark, path)
    return {d: [leaf_shares(trees[t], d) for t in sorted(trees)] for d in depths}


def confusion_by_depth(model, held_out: DataFrame, depths: list[int]) -> dict[int, list[tuple[float, float, int]]]:
    """(label, prediction, rows) of the forest cut at each depth, in one pass: the leaf
    of a row in the deep tree tells its leaf in every cut one."""
    votes = {d: [np.array(t) for t in trees] for d, trees in forest_shares(model, depths).items()}

    def predict(batches):
        for batch in batches:
            leaf = np.stack(batch.column("leaf").to_numpy(zero_copy_only=False)).astype(int) if batch.num_rows else np.empty((0, 0), int)
            for d, trees in votes.items() if batch.num_rows else ():
                raw = np.zeros((len(leaf), trees[0].shape[1]))
                for t, shares in enumerate(trees):
                    raw += shares[leaf[:, t]]
                depth = pa.array(np.full(len(leaf), d, np.int32))
                yield pa.RecordBatch.from_arrays([depth, batch.column("label"), pa.array(raw.argmax(axis=1).astype(float))], ["depth", "label", "prediction"])

    leaves = model.transform(held_out, {model.leafCol: "leaf"}).select(F.col("label").cast("double").alias("label"), vector_to_array("leaf").alias("leaf"))
    counted = leaves.mapInArrow(predict, "depth int, label double, prediction double").groupBy("depth", "label", "prediction").count()
    found: dict[int, list[tuple[float, float, int]]] = {d: [] for d in depths}
    for r in counted.collect():
        found[r.depth].append((r.label, r.prediction, r["count"]))
    return found


def weighted_f1(confusion: list[tuple[float, float, int]]) -> float:
    """Weighted F1 of (label, prediction, rows), as ``f1_evaluator`` gives it."""
    total, f1 = sum(n for _, _, n in confusion), 0.0
    for label in sorted({lab for lab, _, _ in confusion}):
        n = sum(w for lab, _, w in confusion if lab == label)
        said = sum(w for _, p, w in confusion if p == label)
        hits = sum(w for lab, p, w in confusion if lab == p == label)
        precision, recall = hits / said if said else 0.0, hits / n
        f1 += (2 * precision * recall / (precision + recall) if hits else 0.0) * n / total
    return f1


class FitStore:
    """Cross-validation on weighted F1 in which no fit is made twice.

    The training rows are written once with a fold number for every number of
    folds asked for (a hash of the key, the same at any partitioning).  Each
    (estimator, whole parameter map, folds, fold) is scored at most once,
    whichever models and grids ask for it, so a model that is a point of a
    tuned grid costs nothing more.

    Forests that differ in their depth only are one fit, the deepest: forests
    are grown level by level from one seed, so the shallower ones are that
    forest cut at their depth.
    """

    def __init__(self, train: DataFrame, fold_counts: list[int], seed: int = 42, parallelism: int = 8, key: str = "userId"):
        counts = sorted(set(fold_counts))
        numbered = {f"fold_of_{n}": hash_split_column([1.0] * n, seed, key) for n in counts}
        written = materialize(train.withColumns(numbered).drop(key).hint("rebalance"), "folds")
        # every fit makes tens of passes: as few partitions as the rows allow
        parts = max(1, math.ceil(written.count() / ROWS_PER_TASK))
        self.rows = written.repartition(parts) if parts > 1 else written.coalesce(1)
        self.parallelism = max(parallelism, train.sparkSession.sparkContext.defaultParallelism)
        self.f1: dict[tuple, float] = {}
        self.fitted: dict[tuple, object] = {}

    @staticmethod
    def point_key(estimator) -> tuple:
        """The estimator's kind and every parameter value, set or default."""
        return type(estimator).__name__, tuple(sorted((p.name, str(v)) for p, v in estimator.extractParamMap().items()))

    @classmethod
    def growth_key(cls, estimator) -> tuple:
        """The key of a point, for forests without the depth."""
        kind, params = cls.point_key(estimator)
        if isinstance(estimator, RandomForestClassifier) and not estimator.isSet("thresholds"):
            params = tuple(p for p in params if p[0] != "maxDepth")
        return kind, params

    @staticmethod
    def grows_by_level(model) -> bool:
        """Whether a fit held all nodes of its deepest level in one pass (else its
        nodes were taken in another order than those of a shallower forest)."""
        nodes = model.getNumTrees * 2 ** (model.getOrDefault("maxDepth") - 1)
        node_bytes = 8 * model.numClasses * model.numFeatures * model.getOrDefault("maxBins")
        return nodes * node_bytes <= model.getOrDefault("maxMemoryInMB") * 2**20

    def run(self, wanted: list[tuple[list, int]], final: list = ()) -> None:
        """Fit and score what is missing of (points, folds) pairs, and fit the
        estimators of ``final`` on every row, ``parallelism`` fits at a time over
        all of them (a fit is many small jobs)."""
        todo = {(self.point_key(e), folds, i): e for points, folds in wanted for e in points for i in range(folds)}
        grown: dict[tuple, list] = {}
        for (key, folds, i), e in todo.items():
            if (key, folds, i) not in self.f1:
                grown.setdefault((self.growth_key(e), folds, i), []).append(e)
        rows = self.rows.persist()

        def score(folds: int, i: int, points: list) -> None:
            held_out = rows.filter(F.col(f"fold_of_{folds}") == i)
            train = rows.filter(F.col(f"fold_of_{folds}") != i)
            if len(points) == 1:
                self.f1[self.point_key(points[0]), folds, i] = f1_evaluator().evaluate(points[0].fit(train).transform(held_out))
                return
            deepest = max(points, key=lambda e: e.getMaxDepth())
            model = deepest.fit(train)
            if not self.grows_by_level(model):
                for e in points:
                    score(folds, i, [e])
                return
            counts = confusion_by_depth(model, held_out, [e.getMaxDepth() for e in points])
            for e in points:
                self.f1[self.point_key(e), folds, i] = weighted_f1(counts[e.getMaxDepth()])

        def fit(estimator) -> None:
            self.fitted[self.point_key(estimator)] = estimator.fit(rows)

        missing = {self.point_key(e): e for e in final if self.point_key(e) not in self.fitted}
        jobs = [functools.partial(fit, e) for e in missing.values()]
        jobs += [functools.partial(score, folds, i, points) for (_, folds, i), points in grown.items()]
        if jobs:
            with ThreadPool(min(self.parallelism, len(jobs))) as pool:
                pool.map(inheritable_thread_target(rows.sparkSession)(lambda job: job()), jobs, chunksize=1)
        rows.unpersist()

    def cross_validate(self, points: list, folds: int) -> list[float]:
        """M-12: mean weighted F1 over the folds of each estimator in ``points``."""
        self.run([(points, folds)])
        return [statistics.fmean(self.f1[self.point_key(e), folds, i] for i in range(folds)) for e in points]

    def fit(self, estimator):
        """The estimator fitted on every training row."""
        self.run([], [estimator])
        return self.fitted[self.point_key(estimator)]


def grid_points(estimator, grid: dict[str, list] | None) -> list:
    """The estimator at every point of a grid (itself without one)."""
    return [estimator.copy(pm) for pm in param_grid(estimator, grid)] if grid else [estimator]


def cv_metrics(spark: SparkSession, store: FitStore, name: str, estimator, folds: int, grid: dict[str, list] | None = None) -> DataFrame:
    """M-15: average fold metric per grid point as a table."""
    points = grid_points(estimator, grid)
    rows = []
    for i, (point, f1) in enumerate(zip(points, store.cross_validate(points, folds))):
        params = ", ".join(f"{p}={point.getOrDefault(p)}" for p in sorted(grid or {}))
        rows.append((name, i, params, float(f1)))
    return spark.createDataFrame(rows, "model string, grid_point int, params string, avg_f1 double")


# ---------------------------------------------------------------- evaluation


def evaluate(pred: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] | None = None) -> DataFrame:
    """M-13: accuracy and weighted precision / recall / F1, one row (per ``by``).

    Same definitions as Spark's multiclass metrics: per label class,
    precision = tp / (tp + fp) (0 if none predicted), recall = tp / n,
    F1 = 2pr / (p + r) (0 if both 0); weighted by the class share of rows.
    The only pass over the predictions is the confusion count (at most
    classes^2 rows per group); the rest works on that.
    """
    by = by or []
    keys = [F.col(b) for b in by]
    conf = pred.groupBy(*keys, F.col(label).cast("double").alias("l"), F.col(prediction).cast("double").alias("p")).agg(
        F.count(F.lit(1)).cast("double").alias("w")
    )
    per_label = conf.groupBy(*by, "l").agg(
        F.sum("w").alias("n"), F.sum(F.when(F.col("l") == F.col("p"), F.col("w")).otherwise(0.0)).alias("tp")
    )
    per_pred = conf.groupBy(*by, F.col("p").alias("l")).agg(
        F.sum(F.when(F.col("l") != F.col("p"), F.col("w")).otherwise(0.0)).alias("fp")
    )
    cls = per_label.join(per_pred, [*by, "l"], "left").fillna(0.0, ["fp"])
    prec = F.when(F.col("tp") + F.col("fp") == 0, 0.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fp")))
    rec = F.col("tp") / F.col("n")
    cls = cls.withColumns({"prec": prec, "rec": rec})
    f1 = F.when(F.col("prec") + F.col("rec") == 0, 0.0).otherwise(2 * F.col("prec") * F.col("rec") / (F.col("prec") + F.col("rec")))
    cls = cls.withColumn("f1", f1)
    total = F.sum("n")
    return cls.groupBy(*by).agg(
        total.cast("long").alias("n"),
        (F.sum("tp") / total).alias("accuracy"),
        (F.sum(F.col("prec") * F.col("n")) / total).alias("weighted_precision"),
        (F.sum(F.col("rec") * F.col("n")) / total).alias("weighted_recall"),
        (F.sum(F.col("f1") * F.col("n")) / total).alias("weighted_f1"),
    )


def evaluate_splits(model, data: DataFrame, split_col: str = "split", names: list[str] | None = None) -> DataFrame:
    """M-14: metrics per split in one pass (``data`` carries a split number).

    The reference printed its no-argument ``fMeasure()`` as "F1", which is
    accuracy (micro F1, T-14); both are here under their own names."""
    names = names or ["train", "test", "validation"]
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col(split_col) + 1)
    scored = model.transform(data).withColumn("split_name", name)
    return evaluate(scored, by=["split_name"]).withColumnRenamed("split_name", "split")


# ---------------------------------------------------------------- composite jobs


def churn_pipeline(num_trees: int = 100, max_depth: int = 5, seed: int | None = 42) -> Pipeline:
    """M-17: indexer, encoder, assembler, L1 normaliser, random forest
    (100 trees, gini, depth 5, sqrt features).  The reference set no seed;
    a fixed one makes the build repeatable."""
    rf = RandomForestClassifier(
        labelCol="label",
        featuresCol="features",
        numTrees=num_trees,
        impurity="gini",
        maxDepth=max_depth,
        featureSubsetStrategy="sqrt",
        seed=seed,
        checkpointInterval=10,
    )
    return Pipeline(stages=batch_feature_stages() + [rf])


def build_churn_model(bf: DataFrame, seed: int = 42, num_trees: int = 100, dst: str | None = None, overwrite: bool = False):
    """C-7: split 60/20/20 (by user hash), fit the pipeline on train, evaluate
    every split, optionally save.  Returns ``(model, report)``.  Pass a
    materialized feature table (``materialize``): the fit makes many passes."""
    data = bf.withColumnRenamed("churn", "label").withColumn("split", hash_split_column([0.6, 0.2, 0.2], seed))
    train = data.filter(F.col("split") == 0).persist()
    model = churn_pipeline(num_trees=num_trees, seed=seed).fit(train)
    report = evaluate_splits(model, data)
    if dst:
        save_model(model, dst, overwrite=overwrite)
    train.unpersist()
    return model, report


# Seeds, depths, iterations, folds and grids.
SVM_GRID = {"maxIter": [50, 100, 150], "regParam": [0.0, 0.01]}
FOREST_GRID = {"maxDepth": [3, 4, 5, 6, 8], "numTrees": [20, 15, 10, 5]}
MODEL_SPECS = {
    "random_forest": (lambda: train_forest(seed=42, max_depth=5), 10, None),
    "gbt": (lambda: train_gbt(seed=0), 2, None),
    "logistic_regression": (lambda: train_logistic(50), 3, None),
    "linear_svm": (lambda: train_svm(100), 3, None),
    "linear_svm_tuned": (lambda: train_svm(), 3, SVM_GRID),
    "random_forest_tuned": (lambda: train_forest(seed=42), 10, FOREST_GRID),
}


def spec_points(name: str) -> tuple[list, int]:
    """The points and number of folds of one entry of ``MODEL_SPECS``."""
    make, folds, grid = MODEL_SPECS[name]
    return grid_points(make(), grid), folds


def best_of_spec(store: FitStore, name: str):
    """(best point, folds, its mean fold F1) of one entry of ``MODEL_SPECS``."""
    points, folds = spec_points(name)
    f1 = store.cross_validate(points, folds)
    best = max(range(len(points)), key=lambda i: f1[i])
    return points[best], folds, f1[best]


def fit_store(train: DataFrame, names: list[str] | None = None, parallelism: int = 8) -> FitStore:
    """The store for some entries of ``MODEL_SPECS``."""
    return FitStore(train, [MODEL_SPECS[n][1] for n in names or MODEL_SPECS], parallelism=parallelism)


def compare_models(train: DataFrame, valid: DataFrame, names: list[str] | None = None, parallelism: int = 8) -> DataFrame:
    """M-18: cross-validate each model on ``train``, score ``valid``; one row per
    model, tuned ones (best point of their grid) included.  All share one store
    of fits: the untuned forest and SVM are points of the tuned grids."""
    names = names or list(MODEL_SPECS)
    store = fit_store(train, names, parallelism)
    single = [points[0] for points, _ in map(spec_points, names) if len(points) == 1]
    # few folds first: their fits take longest; so do fits on every row
    store.run(sorted(map(spec_points, names), key=lambda w: w[1]), single)
    best = {name: best_of_spec(store, name) for name in names}
    store.run([], [point for point, _, _ in best.values()])
    valid = valid.persist()
    rows = []
    for name, (point, folds, f1) in best.items():
        m = evaluate(store.fit(point).transform(valid)).first()
        rows.append((name, folds, float(f1), m and m.accuracy, m and m.weighted_f1))
    valid.unpersist()
    return train.sparkSession.createDataFrame(rows, "model string, folds int, cv_f1 double, valid_accuracy double, valid_f1 double")
