"""Churn crosstabs (A-8, A-10 .. A-12, A-20, A-22).

Event crosstabs pre-aggregate before anything is spread per user: events are
first counted per (user, category) with the user's cancel flag, then the
churn flag is spread over that small table (at most one row per category
value per user, so a hot user cannot make a large window partition), and
only then summed per (churn, category).  Play lengths by churn are merged
from per-user sums.  No event-level row is joined or windowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from .churn import LATEST_ORDER, cancel_flag, last_event


def user_latest_with_churn(a: DataFrame, cols: list[str]) -> DataFrame:
    """Per user: churn flag and the values of ``cols`` at the last event (T-8:
    a fixed row, not an arbitrary one).  One aggregate, one shuffle."""
    rest = [c for c in cols if c not in LATEST_ORDER]
    last = last_event(a, rest)
    g = a.groupBy("userId").agg(F.max(cancel_flag()).cast("int").alias("churn"), last.alias("_last"))
    return g.select("userId", "churn", *[F.col(f"_last.{c}").alias(c) for c in LATEST_ORDER + rest])


def label_balance(users: DataFrame, by: str = "churn") -> DataFrame:
    """A-22 / A-10 base: users per churn class."""
    return users.groupBy(by).agg(F.count(F.lit(1)).alias("n_users")).orderBy(by)


def user_crosstab(a: DataFrame, dim: Column, name: str) -> DataFrame:
    """A-10: users by churn x a dimension taken at each user's last event."""
    users = user_latest_with_churn(a.withColumn(name, dim), [name])
    return users.groupBy("churn", name).agg(F.count(F.lit(1)).alias("count")).orderBy("churn", name)


def event_crosstab(a: DataFrame, dim: Column, name: str) -> DataFrame:
    """A-11: events by churn x a dimension, pre-aggregated per (user, value)."""
    per_user_value = a.groupBy("userId", dim.alias(name)).agg(
        F.count(F.lit(1)).alias("_n"), F.max(cancel_flag()).alias("_cancel")
    )
    spread = per_user_value.withColumn("churn", F.max("_cancel").over(Window.partitionBy("userId")).cast("int"))
    return spread.groupBy("churn", name).agg(F.sum("_n").alias("count")).orderBy(name, "churn")


def length_stats(a: DataFrame, by: list[str]) -> DataFrame:
    """A-8 / A-9: mean, sample stddev, min and max of ``length`` by a key."""
    return a.groupBy(*by).agg(
        F.avg("length").alias("mean_length"),
        F.stddev_samp("length").alias("stddev_length"),
        F.min("length").alias("minimum_length"),
        F.max("length").alias("maximum_length"),
    )


def length_by_churn(a: DataFrame) -> DataFrame:
    """A-8: play length statistics per churn class.

    One scan and one shuffle of events: per user the count, mean, sum of
    squared deviations, extremes and the cancel flag, then the users of a
    class are merged (sum of deviations inside users and between their means)."""
    return merge_lengths(a.groupBy("userId").agg(F.max(cancel_flag()).cast("int").alias("churn"), *length_sums()))


def length_sums() -> list[Column]:
    """Per user: what ``merge_lengths`` needs of the play lengths."""
    return [
        F.count("length").alias("n"),
        F.avg("length").alias("mean"),
        (F.var_pop("length") * F.count("length")).alias("inside"),
        F.min("length").alias("low"),
        F.max("length").alias("high"),
    ]


def merge_lengths(users: DataFrame) -> DataFrame:
    """Length statistics per churn class from per-user sums."""
    n = F.sum("n").cast("double")
    mean = F.sum(F.col("n") * F.col("mean")) / n
    stats = users.filter(F.col("n") > 0).groupBy("churn").agg(
        n.alias("n"),
        mean.alias("mean_length"),
        F.sum("inside").alias("inside"),
        F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("squares"),
        F.min("low").alias("minimum_length"),
        F.max("high").alias("maximum_length"),
    )
    spread = F.col("inside") + F.col("squares") - F.col("n") * F.col("mean_length") * F.col("mean_length")
    return stats.select(
        "churn",
        "mean_length",
        F.when(F.col("n") > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (F.col("n") - 1))).alias("stddev_length"),
        "minimum_length",
        "maximum_length",
    ).orderBy("churn")


def scaled_crosstab(ct: DataFrame, category: str, by: str = "churn", count: str = "count", classes: list | None = None) -> DataFrame:
    """A-12: complete the category x class grid with 0, min-max scale the
    counts within each class, and keep rows with a defined value.

    ``classes`` are the values of ``by`` (a churn label has 0 and 1; another
    value then raises).  Without them the classes present are found first, by
    a scalar subquery over ``ct``.  The grid is one row per category with a
    map of its classes, laid out over all classes (no cross join), and the
    ranges are a window by class over it, at most one row per category.  A
    class whose counts are all equal has no range and drops out (T-16).
    """
    if classes is None:
        every = ct.agg(F.array_sort(F.collect_set(by))).scalar()
    else:
        every = F.array(*[F.lit(k) for k in classes])
        known = F.when(F.col(by).isin(classes), F.col(by)).otherwise(F.raise_error(F.concat(F.lit(f"{by} outside {classes}: "), F.col(by).cast("string"))))
        ct = ct.select(category, known.alias(by), count)
    wide = ct.filter(F.col(by).isNotNull()).groupBy(category).agg(F.map_from_entries(F.collect_list(F.struct(by, count))).alias("_n"))
    grid = wide.select(category, "_n", F.explode(every).alias(by))
    grid = grid.select(category, by, F.coalesce(F.try_element_at("_n", F.col(by)), F.lit(0)).alias("_count"))
    own = Window.partitionBy(by)
    scaled = X.min_max_scale("_count", F.min("_count").over(own), F.max("_count").over(own))
    return grid.select(category, by, scaled.alias("scaled")).filter(F.col("scaled").isNotNull()).orderBy(by, category)


def ztest_counts(users: DataFrame, dim: str) -> DataFrame:
    """A-20: pooled two-proportion z statistic of the churn rate between the two
    values of ``dim`` (first = smaller value) and its two-sided p-value.

    Users without a value are left out; any other number of values than two
    raises.  One global aggregate over the groups."""
    per = users.filter(F.col(dim).isNotNull()).groupBy(dim).agg(F.count(F.lit(1)).alias("n"), F.sum("churn").alias("x"))
    pair = per.agg(
        F.count(F.lit(1)).alias("groups"),
        F.min_by(F.struct(dim, "n", "x"), F.col(dim)).alias("a"),
        F.max_by(F.struct(dim, "n", "x"), F.col(dim)).alias("b"),
    )
    n1, x1, n2, x2 = (F.col("a.n").cast("double"), F.col("a.x").cast("double"), F.col("b.n").cast("double"), F.col("b.x").cast("double"))
    pooled = (x1 + x2) / (n1 + n2)
    z = F.try_divide(x1 / n1 - x2 / n2, F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2)))
    wrong = F.raise_error(F.concat(F.lit(f"a two-sample test needs two values of {dim}, found "), F.col("groups").cast("string"))).cast("double")
    out = pair.select(
        F.col(f"a.{dim}").alias("group_a"),
        F.col("a.n").alias("n_a"),
        F.col("a.x").alias("churned_a"),
        F.col(f"b.{dim}").alias("group_b"),
        F.col("b.n").alias("n_b"),
        F.col("b.x").alias("churned_b"),
        F.when(F.col("groups") == 2, z).otherwise(wrong).alias("z"),
    )
    return out.withColumn("p_value", X.two_sided_p("z"))
