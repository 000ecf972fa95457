"""Mergeable distinct-user sketches (A-3, A-4, A-6 at scale).

A HyperLogLog sketch per dimension value (and day) is a few kilobytes at most
whatever the number of users.  The table is written once and merged later, over
days, values or a coarser key, without reading events again, and new days
are appended.  Merged sketches count a user once, so a roll-up is the distinct
users of the group, not the sum that ``rolled_up_users`` gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 12


def relative_error(lg_k: int = LG_K) -> float:
    """Standard error of an estimate, as a share of the true count: 1.04 / sqrt(2**lg_k)."""
    return 1.04 / (1 << lg_k) ** 0.5


def user_sketches(a: DataFrame, dims: list[str | Column], lg_k: int = LG_K) -> DataFrame:
    """One sketch of the users of each combination of ``dims`` (column ``users``,
    binary); null is a value of its own, events without a user add nothing."""
    return a.groupBy(*dims).agg(F.hll_sketch_agg("userId", F.lit(lg_k)).alias("users"))


def merge_sketches(sketches: DataFrame, dims: list[str | Column]) -> DataFrame:
    """The sketches of each combination of the coarser ``dims``, again mergeable."""
    return sketches.groupBy(*dims).agg(F.hll_union_agg("users").alias("users"))


def estimated_users(sketches: DataFrame, out: str = "count_users") -> DataFrame:
    """The sketches' estimates in place of the sketches."""
    return sketches.withColumn(out, F.hll_sketch_estimate("users")).drop("users")
