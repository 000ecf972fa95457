"""Churn label, per-user spans and latest values (C-1, W-1 .. W-6, D-3).

The reference spreads per-user values over rows with windows partitioned by
user.  A window puts every row of a user in one task, and a hot user (a
third of the log) would then stall one task with no way for AQE to split
it.  Here per-user values are grouped aggregates (partial aggregation
before the shuffle, so a hot user costs one row per map task) and, where a
value is needed on every row, joined back on ``userId``: AQE either
broadcasts the per-user side when it is measured small, or splits the
skewed partition of the event side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from .bloom import filtered_semi_join

# Order that decides "the last event": time, session, item, and for events alike
# in all three the columns below, larger values last, nulls first.  Every
# operator that looks at a last event orders by the whole list.
LATEST_ORDER = ["ts", "sessionId", "itemInSession"]
TIE_ORDER = ["page", "level", "gender", "location", "userAgent", "auth", "song", "artist", "length"]


def last_event(a: DataFrame, extra: list[str] | None = None) -> Column:
    """Aggregate: the group's last event as a struct of the order's columns that
    ``a`` has, then ``extra`` ones (values derived from the event)."""
    cols = [c for c in [*LATEST_ORDER, *TIE_ORDER] if c in a.columns]
    return F.max(F.struct(*cols, *[c for c in extra or [] if c not in cols]))


def cancel_flag(page="page") -> Column:
    """F-10 on the cancellation page."""
    return X.flag(page, X.CANCELLATION_PAGE)


def churn_labels(a: DataFrame, out: str = "churn") -> DataFrame:
    """C-1: one row per user, 1 if the user ever confirmed a cancellation."""
    return a.groupBy("userId").agg(F.max(cancel_flag()).cast("int").alias(out))


def with_churn(a: DataFrame, out: str = "Churn") -> DataFrame:
    """W-5 / J-5: the user's churn flag on every row."""
    return a.join(churn_labels(a, out), "userId")


def user_span(a: DataFrame) -> DataFrame:
    """Per user: first and last event time (epoch ms)."""
    return a.groupBy("userId").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def events_of_churned(a: DataFrame) -> DataFrame:
    """P-5 / J-5: the events of users who confirmed a cancellation, by a semi-join
    to the users of that page (its filter goes to the scan)."""
    users = a.filter(F.col("page") == X.CANCELLATION_PAGE).select("userId").distinct()
    return a.join(users, "userId", "left_semi")


def events_of_churned_filtered(a: DataFrame) -> DataFrame:
    """P-5 / J-5 behind a Bloom filter of those users: events of others end in the scan
    stage instead of going to the semi-join (``bloom.filtered_semi_join``)."""
    return filtered_semi_join(a, a.filter(F.col("page") == X.CANCELLATION_PAGE), "userId")


def with_user_span(a: DataFrame) -> DataFrame:
    """W-1: first and last event time of the user on every row."""
    return a.join(user_span(a), "userId")


def daily_counts(a: DataFrame, out: str = "events") -> DataFrame:
    """Per (user, date): number of events."""
    return a.withColumn("date", X.event_date("ts")).groupBy("userId", "date").agg(F.count(F.lit(1)).alias(out))


def with_daily_count(a: DataFrame, out: str = "events") -> DataFrame:
    """W-2: count over (user, date) on every row."""
    dated = a.withColumn("date", X.event_date("ts"))
    return dated.join(daily_counts(a, out), ["userId", "date"])


def with_user_count(a: DataFrame, page: str | None = None, out: str = "n") -> DataFrame:
    """W-4: count of the user's rows (optionally of one page) on each of those rows."""
    rows = a if page is None else a.filter(F.col("page") == page)
    counts = rows.groupBy("userId").agg(F.count(F.lit(1)).alias(out))
    return rows.join(counts, "userId")


def latest_per_user(a: DataFrame, cols: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """D-3: the last event of each key (by default each user), one row per key.

    ``max(struct)`` is a regular aggregate: partial on the map side, so the
    shuffle carries one row per key per map task.
    """
    keys = keys or ["userId"]
    cols = cols or [c for c in a.columns if c not in keys]
    out = [c for c in LATEST_ORDER if c not in keys] + [c for c in cols if c not in LATEST_ORDER and c not in keys]
    last = a.groupBy(*keys).agg(last_event(a, out).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in out])


def last_values(a: DataFrame, cols: list[str], prefix: str = "last_") -> DataFrame:
    """W-6: per user, the values of ``cols`` at the last event."""
    last = latest_per_user(a, cols)
    return last.select("userId", F.col("ts").alias("last_ts"), *[F.col(c).alias(prefix + c) for c in cols])
