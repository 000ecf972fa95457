"""User-day states kept as a table (C-2, C-7 over a growing log).

The batch features need, of every event, only what it adds to its user's day:
counts, the cancel flag, the last event.  Each batch of new events writes its
user-day rows to a folder of its own, so writing a batch again replaces it.
Late events are rows for an old day; a reader adds rows of one user and day up.
A later ``as_of`` then reads one row for each user, day and batch, not the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .clean import clean_events
from .features import behaviour_from_daily, daily_activity

COUNTS = ["n_events", "n_songs", "n_up", "n_down", "n_friend"]


def write_states(events: DataFrame, path: str, batch: str) -> None:
    """Write the user-day rows of one batch of raw events under ``path``."""
    daily_activity(clean_events(events)).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def merge_states(states: DataFrame) -> DataFrame:
    """One row for each user and day, as if all events had been in one batch."""
    return states.groupBy("userId", "day").agg(
        *[F.sum(c).alias(c) for c in COUNTS], F.max("cancel").alias("cancel"), F.max("last").alias("last")
    )


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """The merged user-day rows of all batches under ``path``."""
    return merge_states(spark.read.parquet(path))


def compact_states(spark: SparkSession, path: str, into: str, batch: str) -> None:
    """Write the merged rows of ``path`` as one batch of the new table ``into``; the
    old table stays for its readers."""
    read_states(spark, path).write.mode("overwrite").parquet(f"{into}/batch={batch}")


def behaviour_of_states(spark: SparkSession, path: str, as_of: str, keep_silent: bool = False) -> DataFrame:
    """C-2 from the kept states."""
    return behaviour_from_daily(read_states(spark, path), as_of, keep_silent)
