"""Exploration report (C-10): the tables behind every notebook plot and
printout.

Both forms come from two written tables: cells (events per user and value of
each dimension, one shuffle) and users (one row each).  ``explore`` returns the
tables as named frames, ``report_table`` as one long table; the length histogram
scans the events once more.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import churn as CH
from ..operators import clean as CL
from ..operators import crosstab as CT
from ..operators import profile as PR
from ..session import materialize


def explore(raw: DataFrame, top: int = 5, bins: int = 20) -> dict[str, DataFrame]:
    """The tables as named frames.

    The cells and the users are written once; every table by a dimension, class or
    user comes from them.  Only the counts of raw rows, the distinct items and the
    histogram read events again."""
    a = CL.clean_events(raw)
    cells, users = _written(a)
    dim = F.col("dim")
    per_value = cells.groupBy("dim", "value").agg(F.count(F.lit(1)).alias("users"), F.sum("n").alias("events"))
    labelled = cells.join(users.select("userId", "churn"), "userId").groupBy("dim", "value", "churn").agg(F.sum("n").alias("n"))

    def by_value(source: str, counted: str) -> DataFrame:
        rows = per_value.filter(dim == source).select(_typed(source), F.col(counted).alias("count_users"))
        return rows.orderBy(F.desc("count_users"), F.asc_nulls_first(source))

    def rolled(source: str, name: str, derive: Callable[[Column], Column]) -> DataFrame:
        rows = per_value.filter(dim == source).select(derive(F.col("value")).alias(name), "users").filter(F.col(name).isNotNull())
        return rows.groupBy(name).agg(F.sum("users").alias("count_users")).orderBy(F.desc("count_users"), name)

    def by_churn(source: str, name: str, value: Column) -> DataFrame:
        return labelled.filter(dim == source).groupBy("churn", value.alias(name)).agg(F.sum("n").alias("count")).orderBy(name, "churn")

    changed = cells.filter(dim == "level").groupBy("userId").agg(F.count("value").alias("levels"))
    out: dict[str, DataFrame] = {
        "quality_counts": CL.quality_counts(raw),
        "row_count": PR.row_count(raw),
        "profile": PR.profile(raw, ["userId", "sessionId"]),
        "distinct_users": users.agg(F.count(F.lit(1)).alias("unique_users")),
        "distinct_items": PR.distinct_count(a, "itemInSession", "count_items"),
        "distinct_auth": per_value.filter(dim == "auth").select(_typed("auth")),
        "distinct_pages": per_value.filter(dim == "page").select(_typed("page")),
        "events_by_page": by_value("page", "events"),
        "level_changers": changed.agg(F.count_if(F.col("levels") > 1).alias("n_users")),
        "length_histogram": PR.histogram(a, "length", bins, _length_bounds(users)),
        "top_locations": PR.top_k(by_value("location", "users"), "count_users", top, ["location"]),
        "top_agents": PR.top_k(by_value("userAgent", "users"), "count_users", top, ["userAgent"]),
        "churn_counts": CT.label_balance(users),
        "length_by_churn": CT.merge_lengths(users),
    }
    for source, name, derive in ROLLUPS:
        out[f"{name}_rollup"] = rolled(source, name, derive)
    for name in USER_CELLS:
        out[f"users_by_{name}"] = by_value(name, "users")
    names = F.get(F.array(*[F.lit(d) for d in X.WEEKDAYS]), F.col("value").cast("int")).alias("weekday")
    for name in ["weekday", "day", "hour"]:
        rows = per_value.filter(dim == name).select(names if name == "weekday" else _typed(name), F.col("events").alias("n_events"))
        out[f"events_by_{name}"] = rows.orderBy(name)
    for name, col in _at_last().items():
        out[f"churn_by_{name}"] = users.groupBy("churn", col.alias(name)).agg(F.count(F.lit(1)).alias("count")).orderBy("churn", name)
    for name in EVENT_CELLS:
        out[f"events_by_churn_{name}"] = by_churn(name, name, _typed(name))
    for source, name, derive in ROLLUPS[1:]:
        out[f"events_by_churn_{name}"] = by_churn(source, name, derive(F.col("value")))
    for name in ["gender", "level"]:
        out[f"ztest_{name}"] = CT.ztest_counts(users.select(_at_last()[name].alias(name), "churn"), name)
    return out


def scaled(report: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The min-max scaled versions of the crosstabs."""
    names = [k for k in report if k.startswith("churn_by_") and k[9:] in ("city", "state")]
    names += [k for k in report if k.startswith("events_by_churn_")]
    return {f"scaled_{k.rsplit('_', 1)[-1]}": CT.scaled_crosstab(report[k], k.rsplit("_", 1)[-1], classes=[0, 1]) for k in names}


EVENT_CELLS = ["page", "hour", "day", "weekday"]
USER_CELLS = ["auth", "gender", "level", "location", "userAgent"]
NUMBER_CELLS = ["hour", "day", "weekday"]
ROLLUPS: list[tuple[str, str, Callable[[Column], Column]]] = [
    ("location", "state", X.state_group), ("userAgent", "browser", X.browser), ("userAgent", "platform", X.platform),
]


def _typed(dim: str) -> Column:
    """The value of a cell in the type of its dimension, named after it."""
    return (F.col("value").cast("int") if dim in NUMBER_CELLS else F.col("value")).alias(dim)


def _cells(a: DataFrame) -> DataFrame:
    """(userId, dim, value, n): events per user and value of every dimension."""
    values = {"hour": X.hour_of("ts"), "day": X.day_of("ts"), "weekday": X.weekday_of("ts")}
    each = [F.struct(F.lit(d).alias("dim"), values.get(d, F.col(d)).cast("string").alias("value")) for d in USER_CELLS + EVENT_CELLS]
    return a.select("userId", F.explode(F.array(*each)).alias("c")).groupBy("userId", "c.dim", "c.value").agg(F.count(F.lit(1)).alias("n"))


def _at_last() -> dict[str, Column]:
    """Each user's dimensions at the last event."""
    last = {c: F.col(f"last.{c}") for c in ["auth", "gender", "level"]}
    return {**last, "city": X.city("last.location"), "state": X.state_group("last.location")}


def _written(a: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cells and one row for each user, each written once."""
    cells = materialize(_cells(a), "report_cells")
    per_user = a.groupBy("userId").agg(
        F.max(CH.cancel_flag()).cast("int").alias("churn"), *CT.length_sums(), F.count(F.lit(1)).alias("events"), CH.last_event(a).alias("last")
    )
    return cells, materialize(per_user, "report_users")


def _length_bounds(users: DataFrame) -> DataFrame:
    return users.agg(F.min("low").alias("lo"), F.max("high").alias("hi"))


def _long(df: DataFrame, table: Column | str, key: list, value: Column) -> DataFrame:
    """(table, key, value); key columns joined by ``|``, a null shown as ``-``."""
    name = F.lit(table) if isinstance(table, str) else table
    keys = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("-")) for k in key]
    return df.select(name.alias("table"), F.concat_ws("|", *keys).alias("key"), value.cast("double").alias("value"))


def report_table(raw: DataFrame, bins: int = 20) -> DataFrame:
    """C-10 as one long table (table, key, value)."""
    a = CL.clean_events(raw)
    cells, users = _written(a)
    dim = F.col("dim")
    per_value = cells.groupBy("dim", "value").agg(F.count(F.lit(1)).alias("users"), F.sum("n").alias("events"))
    parts = [
        _long(per_value.filter(dim.isin(USER_CELLS)), F.concat(F.lit("users_by_"), dim), ["value"], F.col("users")),
        _long(per_value.filter(dim.isin(EVENT_CELLS)), F.concat(F.lit("events_by_"), dim), ["value"], F.col("events")),
    ]
    for source, name, derive in ROLLUPS:
        rolled = per_value.filter(dim == source).withColumn(name, derive("value")).filter(F.col(name).isNotNull())
        parts.append(_long(rolled.groupBy(name).agg(F.sum("users").alias("n")), f"{name}_rollup", [name], F.col("n")))

    labelled = cells.join(users.select("userId", "churn"), "userId").groupBy("dim", "value", "churn").agg(F.sum("n").alias("n"))
    parts.append(_long(labelled.filter(dim.isin(EVENT_CELLS)), F.concat(F.lit("events_by_churn_"), dim), ["churn", "value"], F.col("n")))
    for source, name, derive in ROLLUPS[1:]:
        derived = labelled.filter(dim == source).groupBy("churn", derive("value").alias(name)).agg(F.sum("n").alias("n"))
        parts.append(_long(derived, f"events_by_churn_{name}", ["churn", name], F.col("n")))

    for name, col in _at_last().items():
        parts.append(_long(users.groupBy("churn", col.alias(name)).agg(F.count(F.lit(1)).alias("n")), f"churn_by_{name}", ["churn", name], F.col("n")))
    for name in ["gender", "level"]:
        test = CT.ztest_counts(users.select(_at_last()[name].alias(name), "churn"), name)
        parts += [_long(test, f"ztest_{name}", [F.lit(c)], F.round(c, 6)) for c in ("z", "p_value")]
    lengths = CT.merge_lengths(users)
    for c in ["mean_length", "stddev_length", "minimum_length", "maximum_length"]:
        parts.append(_long(lengths, "length_by_churn", ["churn", F.lit(c)], F.round(c, 6)))

    changed = cells.filter(dim == "level").groupBy("userId").agg(F.count("value").alias("levels"))
    parts += [
        _long(users.agg(F.sum("events").alias("n")), "row_count", [F.lit("events")], F.col("n")),
        _long(users.agg(F.count(F.lit(1)).alias("n")), "distinct_users", [F.lit("users")], F.col("n")),
        _long(changed.agg(F.count_if(F.col("levels") > 1).alias("n")), "level_changers", [F.lit("users")], F.col("n")),
        _long(CT.label_balance(users), "churn_counts", ["churn"], F.col("n_users")),
    ]
    parts.append(_long(PR.histogram(a, "length", bins, _length_bounds(users)), "length_histogram", ["bin"], F.col("n")))
    return functools.reduce(DataFrame.unionByName, parts)
