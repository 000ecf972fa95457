"""Profiles of the event log (A-1 .. A-7, A-19, A-21, O-4 .. O-6, D-1).

Every table behind a notebook plot or printout, as a DataFrame.  Results are
never pulled to pandas here; a caller collects only what it shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X


def row_count(df: DataFrame, out: str = "n_events") -> DataFrame:
    """A-1: number of rows."""
    return df.agg(F.count(F.lit(1)).alias(out))


def profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """A-2: count, mean, sample stddev, min, max per column, one row per column.

    Like ``describe`` (count of non-null, mean over values read as numbers,
    min/max in the column's own order) but typed: numbers stay doubles, and
    min/max are strings so that one table holds every column.  One scan and
    one global aggregate for all columns.
    """
    aggs = []
    for c in cols:
        num = F.col(c).try_cast("double")
        aggs += [
            F.count(c).alias(f"{c}__n"),
            F.avg(num).alias(f"{c}__mean"),
            F.stddev_samp(num).alias(f"{c}__stddev"),
            F.min(c).cast("string").alias(f"{c}__min"),
            F.max(c).cast("string").alias(f"{c}__max"),
        ]
    wide = df.agg(*aggs)
    rows = ", ".join(
        f"'{c}', `{c}__n`, `{c}__mean`, `{c}__stddev`, `{c}__min`, `{c}__max`" for c in cols
    )
    return wide.selectExpr(f"stack({len(cols)}, {rows}) AS (column, count, mean, stddev, min, max)")


def distinct_count(a: DataFrame, col: str, out: str, approx: bool = False) -> DataFrame:
    """A-3: distinct values of a column; ``approx`` switches to HyperLogLog++."""
    agg = F.approx_count_distinct(col) if approx else F.count_distinct(col)
    return a.agg(agg.alias(out))


def users_by(a: DataFrame, dims: list[str], out: str = "count_users", approx: bool = False) -> DataFrame:
    """A-4 + O-1: distinct users per dimension value, largest first (ties by value).

    Exact by default (a two-level aggregate on (value, user) then value);
    ``approx`` uses HyperLogLog++ sketches, one fixed-size buffer per value,
    for very large logs where about 1% error is acceptable."""
    users = F.approx_count_distinct("userId") if approx else F.count_distinct("userId")
    return (
        a.groupBy(*dims)
        .agg(users.alias(out))
        .orderBy(F.desc(out), *[F.asc_nulls_first(d) for d in dims])
    )


def events_by(a: DataFrame, dims: list[str], out: str = "count_users") -> DataFrame:
    """A-5 + O-2: events (non-null users) per dimension value, largest first."""
    return (
        a.groupBy(*dims)
        .agg(F.count("userId").alias(out))
        .orderBy(F.desc(out), *[F.asc_nulls_first(d) for d in dims])
    )


def rolled_up_users(a: DataFrame, fine: str, coarse: Column, coarse_name: str, out: str = "count_users") -> DataFrame:
    """A-6: sum of per-``fine`` distinct-user counts rolled up to a derived key.

    It is a sum of distinct counts: a user seen under two fine values counts
    twice, as in the reference.  Rows whose derived key is null are left out
    (pandas ``groupby`` drops them).
    """
    fine_counts = a.groupBy(fine).agg(F.count_distinct("userId").alias("_users"))
    return (
        fine_counts.withColumn(coarse_name, coarse)
        .filter(F.col(coarse_name).isNotNull())
        .groupBy(coarse_name)
        .agg(F.sum("_users").alias(out))
        .orderBy(F.desc(out), coarse_name)
    )


TIME_PARTS = {
    "weekday": X.weekday_name,
    "day": X.day_of,
    "hour": X.hour_of,
}


def events_by_time(a: DataFrame, part: str, out: str = "n_events") -> DataFrame:
    """A-7: events per weekday name, day of month or hour."""
    return a.groupBy(TIME_PARTS[part]("ts").alias(part)).agg(F.count("userId").alias(out)).orderBy(part)


def level_changers(a: DataFrame, out: str = "n_users") -> DataFrame:
    """A-19: users seen on more than one level, counted (not 370+321-448 by hand)."""
    per_user = a.groupBy("userId").agg(F.count_distinct("level").alias("_levels"))
    return per_user.agg(F.count_if(F.col("_levels") > 1).alias(out))


def histogram(df: DataFrame, col: str, bins: int = 20, bounds: DataFrame | None = None) -> DataFrame:
    """A-21: equal-width histogram of a numeric column (nulls left out), one row
    for every bin, empty ones too; a column without values has no bins.

    ``bounds`` is a one-row frame (lo, hi) where the range is known already.
    The global min and max are scalar subqueries (one small job, a single
    value each); rows are bucketed with ``floor`` and the maximum is clamped
    into the last bin.  One partial aggregate, one tiny shuffle.
    """
    vals = df.select(F.col(col).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    stats = vals.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi")) if bounds is None else bounds
    lo = stats.select("lo").scalar()
    hi = stats.select("hi").scalar()
    width = (hi - lo) / F.lit(float(bins))
    raw = F.floor(F.coalesce(F.try_divide(F.col("_x") - lo, width), F.lit(0.0)))
    bucket = F.least(raw, F.lit(bins - 1)).cast("int")
    counted = vals.groupBy(bucket.alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").filter(lo.isNotNull()).select(
        "bin",
        (lo + F.col("bin") * width).alias("bin_start"),
        (lo + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("_n", F.lit(0)).alias("n"),
    ).orderBy("bin")


def timeline(a: DataFrame) -> DataFrame:
    """O-4: ``datetime, userId`` in time order (a full sort; limit it for previews).

    The sort key continues with the event's own ``ts``, session and item, so
    that a second (or user) holding a large share of the rows still spreads
    over several range partitions instead of landing in one."""
    keyed = a.select(X.event_datetime("ts").alias("datetime"), "userId", "ts", "sessionId", "itemInSession")
    return keyed.orderBy("datetime", "userId", "ts", "sessionId", "itemInSession").select("datetime", "userId")


def preview(df: DataFrame, n: int, order_by: list) -> DataFrame:
    """O-5: first ``n`` rows in a stated order (deterministic ``take``/``head``)."""
    return df.orderBy(*order_by).limit(n)


def top_k(df: DataFrame, by: str, k: int, tie: list[str]) -> DataFrame:
    """O-6: the ``k`` largest by ``by`` (ties by ``tie``): TakeOrderedAndProject."""
    return df.orderBy(F.desc(by), *tie).limit(k)


def distinct_values(a: DataFrame, col: str) -> DataFrame:
    """D-1: distinct values of a column."""
    return a.select(col).distinct()
