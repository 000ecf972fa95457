"""Per-user features (A-9, A-13 .. A-18, C-2 .. C-5).

The reference builds each feature as its own aggregate and joins five to
seven of them back together.  Here each feature set is one aggregate per
grain over one scan of the events:

* batch set (C-2): group by (user, date), then by user: two shuffles, the
  second carrying one row per user-day partial;
* notebook set (C-3..C-5): one group by user with conditional counts,
  distinct counts and the last-event struct; the label dictionary is a
  StringIndexer fit (one distinct-values job, bounded by the categories).

Every aggregate is partial-before-shuffle, so a user with a third of the
log adds one row per map task to the shuffle, not a third of the rows (the
distinct counts of songs and artists: one row per value and map task).
"""

from __future__ import annotations

import functools
import operator

from pyspark.ml.feature import StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..session import materialize
from ..sources.schema import CATEGORICAL_FEATURES, NUMERICAL_FEATURES, PIVOT_PAGES
from .churn import cancel_flag, last_event
from .clean import after_noon_hour, clean_events, in_first_half_of_month, row_sum, zero_fill
from .codes import count_pairs, encode, number_codes


def _is(page: str) -> Column:
    return F.col("page") == page


# --------------------------------------------------------------------------
# Batch feature set (data job)
# --------------------------------------------------------------------------

def daily_activity(a: DataFrame) -> DataFrame:
    """Per (user, UTC day number): events, plays, counts of the three pages, the
    cancel flag and the last event."""
    return (
        a.groupBy("userId", X.event_day("ts").alias("day"))
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.count_if(_is(X.PLAY_PAGE)).alias("n_songs"),
            F.count_if(_is(X.THUMBS_UP_PAGE)).alias("n_up"),
            F.count_if(_is(X.THUMBS_DOWN_PAGE)).alias("n_down"),
            F.count_if(_is(X.ADD_FRIEND_PAGE)).alias("n_friend"),
            F.max(cancel_flag()).alias("cancel"),
            last_event(a).alias("last"),
        )
    )


def avg_per_active_day(a: DataFrame, page: str | None, out: str) -> DataFrame:
    """A-16 / A-17: average daily count over days with such events, rounded to 2."""
    rows = a if page is None else a.filter(_is(page))
    per_day = rows.groupBy("userId", X.event_day("ts").alias("day")).agg(F.count(F.lit(1)).alias("_n"))
    return per_day.groupBy("userId").agg(X.round2(F.avg("_n")).alias(out))


def page_count(a: DataFrame, page: str, out: str) -> DataFrame:
    """A-18: count of one page per user (users without it are absent)."""
    return a.filter(_is(page)).groupBy("userId").agg(F.count(F.lit(1)).alias(out))


def behaviour_features(a: DataFrame, as_of: str, keep_silent: bool = False) -> DataFrame:
    """C-2: the 11-column batch feature table, one row per user.

    ``as_of`` (``yyyy-MM-dd``) replaces the reference's "today".  Users with
    no play are dropped (inner join in the reference) unless ``keep_silent``;
    users with a null gender, level or location at their last event are
    dropped (T-2).  Ties at the last ``ts`` go to the larger sessionId, then
    itemInSession (T-1).
    """
    return behaviour_from_daily(daily_activity(clean_events(a)), as_of, keep_silent)


def behaviour_from_daily(daily: DataFrame, as_of: str, keep_silent: bool = False) -> DataFrame:
    """C-2 from (user, day) rows of ``daily_activity``, one row for each user and day."""
    users = daily.groupBy("userId").agg(
        F.max("cancel").cast("int").alias("churn"),
        X.day_date(F.min("day")).alias("first_date"),
        F.avg("n_events").alias("_avg_events"),
        F.sum("n_songs").alias("_songs"),
        F.count_if(F.col("n_songs") > 0).alias("_song_days"),
        F.sum("n_up").alias("thumbs_up"),
        F.sum("n_down").alias("thumbs_down"),
        F.sum("n_friend").alias("addfriend"),
        F.max("last").alias("last"),
    )
    if not keep_silent:
        users = users.filter(F.col("_song_days") > 0)
    out = users.select(
        "userId",
        F.col("last.gender").alias("gender"),
        "churn",
        F.col("last.level").alias("last_level"),
        X.days_active("first_date", as_of).alias("days_active"),
        X.state_code("last.location").alias("last_state"),
        F.coalesce(X.round2(X.ratio("_songs", "_song_days")), F.lit(0.0)).alias("avg_songs"),
        X.round2("_avg_events").alias("avg_events"),
        "thumbs_up",
        "thumbs_down",
        "addfriend",
    )
    return out.dropna(subset=["gender", "last_level", "last_state"])


# --------------------------------------------------------------------------
# Notebook feature set
# --------------------------------------------------------------------------

def _distinct_with_null(value: str, rows: Column) -> Column:
    """Distinct values of ``value`` among ``rows``, a null counting as one value
    (what ``dropDuplicates([...]).count()`` does, T-9)."""
    return F.count_distinct(F.when(rows, F.col(value))) + F.max(F.when(rows & F.col(value).isNull(), 1).otherwise(0))


def category_sets() -> list[Column]:
    """Per-user sets of the four categorical values (a few values each): the
    union over users is the set over all events, so the label dictionary can
    be fitted on the per-user table instead of a second scan of the events."""
    return [
        F.collect_set("gender").alias("_set_gender"),
        F.collect_set("level").alias("_set_level"),
        F.collect_set(X.browser("userAgent")).alias("_set_browser"),
        F.collect_set(X.platform("userAgent")).alias("_set_platform"),
    ]


def user_aggregates(a: DataFrame, pages: list[str] = PIVOT_PAGES, sets: bool = False) -> DataFrame:
    """One row per user with every notebook aggregate (cleaned input)."""
    play = _is(X.PLAY_PAGE)
    return a.groupBy("userId").agg(
        *(category_sets() if sets else []),
        F.avg("length").alias("average_length"),
        F.stddev_samp("length").alias("stddev_length"),
        F.max("length").alias("max_length"),
        F.min("length").alias("min_length"),
        *[F.count_if(_is(p)).alias(p) for p in pages],
        _distinct_with_null("song", play).alias("unique_songs"),
        F.count_if(play).alias("total_songs"),
        _distinct_with_null("artist", play).alias("unique_artists"),
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(in_first_half_of_month()).alias("day_count"),
        F.count_if(after_noon_hour()).alias("hourofday_count"),
        F.max(cancel_flag()).cast("int").alias("Churn"),
        last_event(a).alias("last"),
    )


def user_length_stats(a: DataFrame) -> DataFrame:
    """A-9: per-user length statistics (stddev null for a single play)."""
    return a.groupBy("userId").agg(
        F.avg("length").alias("average_length"),
        F.stddev_samp("length").alias("stddev_length"),
        F.max("length").alias("max_length"),
        F.min("length").alias("min_length"),
    )


def page_pivot(a: DataFrame, pages: list[str] = PIVOT_PAGES, total: str | None = "sum_pages") -> DataFrame:
    """A-13 (+ P-12): count per listed page, one column each, 0 when absent (T-12).

    Same result as ``groupBy.pivot(page, pages).count().fillna(0)`` but as
    conditional counts: one partial aggregate and no pivot values job.
    """
    g = a.groupBy("userId").agg(*[F.count_if(_is(p)).alias(p) for p in pages])
    return row_sum(g, pages, total) if total else g


def play_counts(a: DataFrame) -> DataFrame:
    """A-14: total plays, unique songs, unique artists per user with plays (a null
    song or artist is one value, T-9).

    Two grains: plays by (user, song or artist, value), then by user.  Only plays
    are read as two narrow rows each; two distinct counts in one aggregate would
    copy every event three times.
    """
    values = F.array(F.struct(F.lit(True).alias("is_song"), F.col("song").alias("value")), F.struct(F.lit(False).alias("is_song"), F.col("artist").alias("value")))
    by_value = a.filter(_is(X.PLAY_PAGE)).select("userId", F.inline(values)).groupBy("userId", "is_song", "value").agg(F.count(F.lit(1)).alias("_n"))
    return by_value.groupBy("userId").agg(
        F.sum(F.when(F.col("is_song"), F.col("_n"))).alias("total_songs"),
        F.count_if("is_song").alias("unique_songs"),
        F.count_if(~F.col("is_song")).alias("unique_artists"),
    )


def share_of_events(a: DataFrame, predicate: Column, out: str) -> DataFrame:
    """A-15 / J-4: share of the user's events meeting ``predicate``; users with
    none are absent (the reference's inner self-join), no join needed."""
    g = a.groupBy("userId").agg(F.count_if(predicate).alias("_hit"), F.count(F.lit(1)).alias("_all"))
    return g.filter(F.col("_hit") > 0).select("userId", (F.col("_hit") / F.col("_all")).alias(out))


def numerical_features(a: DataFrame, keep_silent: bool = False) -> DataFrame:
    """C-4: userId + the 18 numerical features.

    Users without plays, without events on days 1-15 or without events
    after 12h are dropped like the reference's inner joins (T-3, T-4),
    unless ``keep_silent``.
    """
    return numerical_projection(user_aggregates(clean_events(a)), keep_silent)


def numerical_projection(g: DataFrame, keep_silent: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """The 18 numerical features from a ``user_aggregates`` table."""
    if not keep_silent:
        g = g.filter((F.col("total_songs") > 0) & (F.col("day_count") > 0) & (F.col("hourofday_count") > 0))
    pages_sum = functools.reduce(operator.add, [F.col(f"`{p}`") for p in PIVOT_PAGES])
    return g.select(
        "userId",
        "average_length",
        "stddev_length",
        "max_length",
        "min_length",
        *[F.col(f"`{p}`") for p in PIVOT_PAGES],
        pages_sum.alias("sum_pages"),
        "unique_songs",
        "total_songs",
        "unique_artists",
        X.ratio("day_count", "total_count").alias("month_percentage"),
        X.ratio("hourofday_count", "total_count").alias("hour_percentage"),
        *extra,
    )


def with_categories(df: DataFrame, source: str = "last") -> DataFrame:
    """The four categorical values from a last-event struct column."""
    return df.withColumns(
        {
            "gender": F.col(f"{source}.gender"),
            "level": F.col(f"{source}.level"),
            "browser": X.browser(f"{source}.userAgent"),
            "platform": X.platform(f"{source}.userAgent"),
        }
    )


def category_columns(a: DataFrame, cols: list[str] = CATEGORICAL_FEATURES) -> DataFrame:
    """The four categorical values of every event."""
    return a.select(
        "gender", "level", X.browser("userAgent").alias("browser"), X.platform("userAgent").alias("platform")
    ).select(*cols)


def fit_label_codes(a: DataFrame, cols: list[str] = CATEGORICAL_FEATURES):
    """M-6 dictionary: codes 0..n-1 in alphabetical order over all events
    (T-10: the reference used arbitrary distinct order).  A StringIndexer
    fit: one distributed count of distinct values, labels held by the model."""
    events = category_columns(a, cols)
    indexer = StringIndexer(
        inputCols=cols, outputCols=[f"_{c}_code" for c in cols], stringOrderType="alphabetAsc", handleInvalid="keep"
    )
    return indexer.fit(events)


def fit_label_codes_from_sets(users: DataFrame, cols: list[str] = CATEGORICAL_FEATURES):
    """M-6 dictionary fitted on per-user value sets (``category_sets``): same
    labels as ``fit_label_codes`` over the events, without reading them."""
    parts = [
        users.select(*[(F.explode(f"_set_{c}") if o == c else F.lit(None).cast("string")).alias(o) for o in cols])
        for c in cols
    ]
    values = functools.reduce(DataFrame.unionByName, parts)
    indexer = StringIndexer(
        inputCols=cols, outputCols=[f"_{c}_code" for c in cols], stringOrderType="alphabetAsc", handleInvalid="keep"
    )
    return indexer.fit(values)


def label_dictionary(a: DataFrame, cols: list[str] = CATEGORICAL_FEATURES) -> DataFrame:
    """M-6: the code table (column, value, code) of a fitted label encoding.

    The distinct value combinations are coded once and turned into rows with
    ``stack`` (one pass, no union of per-column branches)."""
    model = fit_label_codes(a, cols)
    coded = model.transform(category_columns(a, cols).distinct())
    pairs = ", ".join(f"'{c}', `{c}`, CAST(`_{c}_code` AS INT)" for c in cols)
    long = coded.selectExpr(f"stack({len(cols)}, {pairs}) AS (column, value, code)")
    return long.filter(F.col("value").isNotNull()).distinct()


def apply_label_codes(model, df: DataFrame, cols: list[str] = CATEGORICAL_FEATURES) -> DataFrame:
    """Replace each categorical column by its int code (null stays null)."""
    coded = model.transform(df)
    return coded.withColumns(
        {c: F.when(F.col(c).isNotNull(), F.col(f"_{c}_code").cast("int")) for c in cols}
    ).drop(*[f"_{c}_code" for c in cols])


def categorical_features(a: DataFrame) -> DataFrame:
    """C-3: userId + gender, level, browser, platform codes at the last event.

    One aggregate per user (last event and the value sets), written once to
    the shared folder; the dictionary is fitted on it and it is encoded: one
    scan of the events.
    """
    a = clean_events(a)
    users = materialize(a.groupBy("userId").agg(last_event(a).alias("last"), *category_sets()), "user_categories")
    coded = apply_label_codes(fit_label_codes_from_sets(users), with_categories(users))
    return coded.select("userId", *CATEGORICAL_FEATURES)


def categorical_features_joined(a: DataFrame) -> DataFrame:
    """C-3 with a dictionary that is a table and is joined: the same codes, no label
    in the driver, so the columns may have any number of values."""
    a = clean_events(a)
    users = materialize(a.groupBy("userId").agg(last_event(a).alias("last"), *category_sets()), "user_categories")
    sets = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_set_{c}").alias("values")) for c in CATEGORICAL_FEATURES])
    codes = number_codes(count_pairs(users.select(F.inline(sets)).select("column", F.explode("values").alias("value"))))
    values = with_categories(users).select("userId", *CATEGORICAL_FEATURES)
    coded = encode(values, codes, {c: f"{c}_code" for c in CATEGORICAL_FEATURES})
    return coded.select("userId", *[F.col(f"{c}_code").cast("int").alias(c) for c in CATEGORICAL_FEATURES])


def training_set(a: DataFrame, keep_silent: bool = False) -> DataFrame:
    """C-5: userId, 4 int codes, 18 float features, Churn; nulls to 0.

    Categorical, numerical and label parts come from one per-user aggregate,
    so no join is needed between them.  That table is written once to the
    shared folder (it is read twice: by the dictionary fit over every user,
    and by the encoding of the kept users), so the events are scanned once.
    """
    users = materialize(user_aggregates(clean_events(a), sets=True), "user_aggregates")
    codes = fit_label_codes_from_sets(users)
    num = with_categories(numerical_projection(users, keep_silent, extra=("Churn", "last")))
    coded = apply_label_codes(codes, num)
    out = coded.select(
        "userId",
        *[F.col(c).cast("int").alias(c) for c in CATEGORICAL_FEATURES],
        *[F.col(f"`{c}`").cast("float").alias(c) for c in NUMERICAL_FEATURES],
        F.col("Churn").cast("int").alias("Churn"),
    )
    return zero_fill(out)
