"""Projections, filters and null handling (P-1 .. P-14)."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X


def clean_events(df: DataFrame) -> DataFrame:
    """P-1: drop rows with a blank user; a null user fails ``!=`` and goes too."""
    return df.filter(F.col("userId") != "")


def quality_counts(df: DataFrame) -> DataFrame:
    """P-2: null user, null session and blank user counts in one pass."""
    return df.agg(
        F.count_if(F.col("userId").isNull()).alias("null_user_ids"),
        F.count_if(F.col("sessionId").isNull()).alias("null_session_ids"),
        F.count_if(F.col("userId") == "").alias("blank_user_ids"),
    )


def events_on(a: DataFrame, page: str) -> DataFrame:
    """P-3: events of one page."""
    return a.filter(F.col("page") == page)


def in_first_half_of_month(ts="ts") -> Column:
    """P-4: event on day 1..15 of its month."""
    return X.day_of(ts) <= 15


def after_noon_hour(ts="ts") -> Column:
    """P-4: event with hour > 12 (strict, as in the reference)."""
    return X.hour_of(ts) > 12


def churned_events(a: DataFrame, flag: str = "churn") -> DataFrame:
    """P-5: rows of churned users."""
    return a.filter(F.col(flag) == 1)


def zero_fill(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """P-7: nulls to 0, in ``cols`` or in every numeric column."""
    return df.fillna(0, subset=cols) if cols else df.fillna(0)


def cast_columns(df: DataFrame, types: dict[str, str], safe: bool = False) -> DataFrame:
    """P-8: bulk casts in one projection; ``safe`` uses ``try_cast`` (bad input gives null)."""
    def conv(c: str, t: str) -> Column:
        col = F.col(f"`{c}`")
        return col.try_cast(t) if safe else col.cast(t)

    return df.withColumns({c: conv(c, t) for c, t in types.items()})


def map_values(df: DataFrame, column: str, mapping: dict) -> DataFrame:
    """P-11: replace values of a column by a (small, driver-side) mapping."""
    return df.replace(mapping, subset=[column])


def map_values_from(df: DataFrame, column: str, mapping: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """P-11 for a mapping of any size: values of ``column`` found among ``key`` of the
    table ``mapping`` become its ``value`` (null too); others stay as they are.

    Keys and values take the column's type.  A null in the column stays null,
    null keys are left out, and a key that occurs twice ends the job.  The join
    has no hint: the mapping is broadcast only at a measured size.
    """
    k, v, hit, cols = "_map_key", "_map_value", "_map_hit", df.columns
    if clash := {k, v, hit} & set(cols):
        raise ValueError(f"columns {sorted(clash)} are used by the mapping")
    as_column = df.schema[column].dataType
    pairs = mapping.select(F.col(f"`{key}`").cast(as_column).alias(k), F.col(f"`{value}`").cast(as_column).alias(v)).filter(F.col(k).isNotNull())
    once = pairs.groupBy(k).agg(F.count(F.lit(1)).alias(hit), F.first(v).alias(v))
    twice = F.raise_error(F.concat(F.lit(f"mapping of {column} has a key twice: "), F.col(k).cast("string"))).cast("long")
    once = once.withColumn(hit, F.when(F.col(hit) == 1, F.col(hit)).otherwise(twice))
    old = F.col(f"`{column}`")
    joined = df.join(once, old == F.col(k), "left")
    return joined.select(*[F.when(F.col(hit).isNotNull(), F.col(v)).otherwise(old).alias(c) if c == column else F.col(f"`{c}`") for c in cols])


def row_sum(df: DataFrame, cols: list[str], out: str) -> DataFrame:
    """P-12: row-wise sum of columns."""
    return df.withColumn(out, functools.reduce(operator.add, [F.col(f"`{c}`") for c in cols]))
