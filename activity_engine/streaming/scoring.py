"""Streaming scoring of requests (C-9).

A fitted pipeline is stateless per row, so the batch scoring plan
(``plans.score.score_requests``) runs unchanged on a streaming source: no
watermark, no state store.  The sink is a file table with its checkpoint in
the shared folder, so a restarted query resumes where it stopped and a lost
executor only re-runs its micro-batch.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.score import score_requests
from ..sources.schema import REQUEST_SCHEMA


def request_stream(spark: SparkSession, source: str, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """Unbounded DataFrame of requests arriving as files in ``source``."""
    reader = spark.readStream.schema(REQUEST_SCHEMA).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(source)


def score_stream(model: PipelineModel, requests: DataFrame, as_of: str) -> DataFrame:
    """C-9: the scored stream, ``request_id, outcome`` (-1 when unscorable)."""
    return score_requests(model, requests, as_of)


def start_scoring(
    model: PipelineModel,
    spark: SparkSession,
    source: str,
    sink: str,
    checkpoint: str,
    as_of: str,
    available_now: bool = False,
    processing_time: str = "30 seconds",
    max_files: int | None = None,
) -> StreamingQuery:
    """Start the scoring query: files in ``source`` -> parquet in ``sink``, at
    most ``max_files`` of them in a micro-batch."""
    scored = score_stream(model, request_stream(spark, source, max_files=max_files), as_of)
    writer = scored.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
    return writer.start()
