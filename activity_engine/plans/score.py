"""Scoring requests with a fitted churn pipeline (C-8).

The reference's scoring page built a one-row DataFrame per request, ran the
model up to three times on it and answered -1 when the model returned no
row (an unseen category is skipped by the indexer).  Here a whole batch (or
a stream, C-9) of requests is scored in one pass over its input: categories
are looked up by copies of the fitted indexers that keep unseen values, rows
that cannot be scored get a known category and zeros for the model's sake
and -1 as their outcome.  No shuffle, no union, one read of the source.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X

NUMERIC_REQUEST_COLUMNS = {
    "avg_songs": ("avgSongs", "double"),
    "avg_events": ("avgEvents", "double"),
    "thumbs_up": ("thumbsup", "int"),
    "thumbs_down": ("thumbsdown", "int"),
    "addfriend": ("add_friend", "int"),
}


def _number(name: str, to: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("0")).try_cast("double").try_cast(to)


def request_features(requests: DataFrame, as_of: str) -> DataFrame:
    """Raw request fields to the model's input columns.

    ``days_active`` counts days from ``reg_date`` to ``as_of``; a date that
    does not parse gives null (the reference raised).  A missing number is 0,
    as in the reference's form; one that does not parse gives null; an int
    field may be written ``2.0``."""
    reg = F.try_to_timestamp(F.col("reg_date"), F.lit("yyyy-MM-dd")).cast("date")
    return requests.select(
        "request_id",
        X.gender_code("gender").alias("gender"),
        F.col("level").alias("last_level"),
        F.datediff(F.to_date(F.lit(as_of)), reg).alias("days_active"),
        F.col("location").alias("last_state"),
        *[_number(src, t).alias(out) for out, (src, t) in NUMERIC_REQUEST_COLUMNS.items()],
    )


def known_categories(model: PipelineModel) -> dict[str, list[str]]:
    """Labels of every indexed input column of a fitted pipeline."""
    known: dict[str, list[str]] = {}
    for stage in model.stages:
        if isinstance(stage, StringIndexerModel):
            cols = stage.getInputCols() if stage.isSet("inputCols") else [stage.getInputCol()]
            for c, labels in zip(cols, stage.labelsArray):
                known[c] = list(labels)
    return known


def with_scorable(model: PipelineModel, feats: DataFrame, numeric: list[str], out: str = "_ok") -> DataFrame:
    """Flag rows whose categories were all seen in training and whose numbers are
    all there, and put a known category and 0 in the place of what is not."""
    ok = F.lit(True)
    for stage in model.stages:
        if isinstance(stage, StringIndexerModel):
            cols = stage.getInputCols() if stage.isSet("inputCols") else [stage.getInputCol()]
            keeping = stage.copy().setHandleInvalid("keep")
            outs = [f"_{c}_index" for c in cols]
            keeping = keeping.setOutputCols(outs) if stage.isSet("inputCols") else keeping.setOutputCol(outs[0])
            feats = keeping.transform(feats)
            for c, index, labels in zip(cols, outs, stage.labelsArray):
                seen = f"_{c}_seen"
                feats = feats.withColumn(seen, F.col(c).isNotNull() & (F.col(index) < len(labels)))
                feats = feats.withColumn(c, F.when(F.col(seen), F.col(c)).otherwise(F.lit(labels[0])))
                ok = ok & F.col(seen)
    for c in numeric:
        ok = ok & F.col(c).isNotNull()
    feats = feats.withColumn(out, ok)
    feats = feats.fillna(0, numeric) if numeric else feats
    return feats.drop(*[c for c in feats.columns if c.startswith("_") and c.endswith(("_index", "_seen"))])


def score_requests(model: PipelineModel, requests: DataFrame, as_of: str) -> DataFrame:
    """C-8: ``request_id, outcome``: 1 churns, 0 stays, -1 cannot be scored.

    Works unchanged on a streaming DataFrame (stateless)."""
    feats = with_scorable(model, request_features(requests, as_of), ["days_active", *NUMERIC_REQUEST_COLUMNS])
    outcome = F.when(F.col("_ok"), F.col("prediction").cast("int")).otherwise(F.lit(-1))
    return model.transform(feats).select("request_id", outcome.alias("outcome"))


def requests_from_features(bf: DataFrame, as_of: str) -> DataFrame:
    """Scoring requests in the form's shape from a batch feature table (one per
    user; ``reg_date`` = ``as_of`` minus ``days_active``), for scoring known
    users in bulk."""
    reg = F.date_format(F.date_sub(F.to_date(F.lit(as_of)), F.col("days_active")), "yyyy-MM-dd")
    return bf.select(
        F.xxhash64("userId").alias("request_id"),
        F.when(F.col("gender") == "M", F.lit("male")).otherwise(F.lit("female")).alias("gender"),
        F.col("avg_events").cast("string").alias("avgEvents"),
        F.col("avg_songs").cast("string").alias("avgSongs"),
        F.col("thumbs_up").cast("string").alias("thumbsup"),
        F.col("thumbs_down").cast("string").alias("thumbsdown"),
        F.col("addfriend").cast("string").alias("add_friend"),
        reg.alias("reg_date"),
        F.col("last_level").alias("level"),
        F.col("last_state").alias("location"),
    )
