"""Batch model job (C-7 entry point): event log in, fitted churn model out.

    python -m activity_engine.jobs EVENTS_PATH MODEL_PATH --as-of 2025-01-01 [--format json]

Reads the log with the declared schema, cleans it, builds the batch feature
table, writes it once to the shared folder, splits 60/20/20 by user hash,
fits the 7-stage pipeline on the training split, saves it and prints the
metrics of every split (accuracy and weighted F1 under their own names).
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from .operators.clean import clean_events
from .operators.features import behaviour_features
from .plans.ml import build_churn_model, materialize
from .session import drop_intermediates, prepare
from .sources.schema import read_events


def build_model_job(
    spark: SparkSession, src: str, dst: str, as_of: str, fmt: str = "json", num_trees: int = 100, seed: int = 42,
    overwrite: bool = False,
) -> DataFrame:
    """Run the job; returns the per-split metrics table."""
    prepare(spark)
    events = clean_events(read_events(spark, src, fmt))
    features = materialize(behaviour_features(events, as_of), "model_job_features")
    try:
        _, report = build_churn_model(features, seed=seed, num_trees=num_trees, dst=dst, overwrite=overwrite)
        rows = report.collect()  # one row a split
        return spark.createDataFrame(rows, report.schema)
    finally:
        drop_intermediates(spark)


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("events")
    ap.add_argument("model")
    ap.add_argument("--as-of", required=True, help="yyyy-MM-dd; days_active counts up to this date")
    ap.add_argument("--format", default="json", choices=["json", "parquet"])
    ap.add_argument("--trees", type=int, default=100)
    ap.add_argument("--seed", type=int, default=42)
    ap.add_argument("--overwrite", action="store_true")
    args = ap.parse_args(argv)
    spark = SparkSession.builder.appName("churn-model-job").getOrCreate()
    report = build_model_job(spark, args.events, args.model, args.as_of, args.format, args.trees, args.seed, args.overwrite)
    report.show(truncate=False)


if __name__ == "__main__":
    main()
