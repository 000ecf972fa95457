"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and their SQL.

Each query reads the whole test tables through the activity view and runs
one engine operator on it.  Doubles that come out of floating sums (means,
standard deviations, scaled values) are rounded to 6 places on both sides
so that the comparison does not hinge on summation order.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import churn as CH
from ..operators import clean as CL
from ..operators import crosstab as CT
from ..operators import features as FE
from ..operators import profile as PR
from ..operators.codes import build_codes, encode
from ..operators.sketches import estimated_users, merge_sketches, relative_error, user_sketches
from ..operators.states import behaviour_of_states, write_states
from ..session import materialize
from ..sources import fixtures
from ..sources.schema import schema_report
from . import oracle_sql as O
from .oracle_sql import ACTIVITY, CLEAN, DIMS, LABELS, LATEST, with_ctes

AS_OF = O.AS_OF
DIGITS = 6

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def raw(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.activity(spark, d)


def clean(spark: SparkSession, d: str) -> DataFrame:
    return CL.clean_events(raw(spark, d))


def rounded(df: DataFrame, cols: list[str], digits: int = DIGITS) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


def sql(body: str, *ctes: str) -> str:
    return with_ctes(ACTIVITY, *ctes, body=body)


CLEAN_CTES = (CLEAN,)
LABEL_CTES = (CLEAN, LABELS)
DIM_CTES = (CLEAN, LABELS, DIMS)
STATE_SQL = "CASE WHEN strpos({x}, ',') > 0 THEN trim(split_part({x}, ',', 2)) END"
CODE_SQL = (
    "CASE WHEN length(trim(string_split({x}, ',')[-1])) > 2 "
    "THEN trim(string_split(trim(string_split({x}, ',')[-1]), '-')[-1]) "
    "ELSE trim(string_split({x}, ',')[-1]) END"
)

# ---------------------------------------------------------------- sources / filters


@register("clean_events", sql("SELECT * FROM activity WHERE userId <> ''"))
def q_clean_events(spark, d):
    return clean(spark, d)


@register(
    "quality_counts",
    sql(
        "SELECT count(*) FILTER (WHERE userId IS NULL) AS null_user_ids, "
        "count(*) FILTER (WHERE sessionId IS NULL) AS null_session_ids, "
        "count(*) FILTER (WHERE userId = '') AS blank_user_ids FROM activity"
    ),
)
def q_quality_counts(spark, d):
    return CL.quality_counts(raw(spark, d))


@register("row_count", sql("SELECT count(*) AS n_events FROM activity"))
def q_row_count(spark, d):
    return PR.row_count(raw(spark, d))


@register(
    "profile",
    sql(
        "SELECT 'userId' AS column, count(userId) AS count, round(avg(TRY_CAST(userId AS DOUBLE)), 6) AS mean, "
        "round(stddev_samp(TRY_CAST(userId AS DOUBLE)), 6) AS stddev, min(userId) AS min, max(userId) AS max FROM activity "
        "UNION ALL "
        "SELECT 'sessionId', count(sessionId), round(avg(CAST(sessionId AS DOUBLE)), 6), "
        "round(stddev_samp(CAST(sessionId AS DOUBLE)), 6), CAST(min(sessionId) AS VARCHAR), CAST(max(sessionId) AS VARCHAR) FROM activity"
    ),
)
def q_profile(spark, d):
    return rounded(PR.profile(raw(spark, d), ["userId", "sessionId"]), ["mean", "stddev"])


@register(
    "schema_report",
    sql(
        "SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS position, column_name AS column, "
        "CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' "
        "ELSE lower(column_type) END AS type FROM (DESCRIBE (SELECT * FROM activity))"
    ),
)
def q_schema_report(spark, d):
    return schema_report(raw(spark, d)).drop("nullable")


@register("json_event_log", sql("SELECT * FROM activity WHERE userId <> ''"))
def q_json_event_log(spark, d):
    """S-1 / S-3: the log written as JSON lines to the shared folder and read back
    with the declared event schema (the reference's input format)."""
    from ..session import scratch_path
    from ..sources.schema import ACTIVITY_COLUMNS, read_events

    path = scratch_path(spark, f"json_event_log/{zlib.crc32(d.encode())}/{uuid.uuid4().hex}")
    raw(spark, d).write.mode("overwrite").json(path)
    return CL.clean_events(read_events(spark, path, "json")).select(*ACTIVITY_COLUMNS)


@register(
    "log_line_counts",
    sql(
        "SELECT count(*) AS n_lines, count(*) FILTER (broken) AS n_malformed, count(*) FILTER (NOT broken AND userId IS NULL) AS n_null_user, "
        "count(*) FILTER (NOT broken AND userId = '') AS n_blank_user, count(*) FILTER (NOT broken AND userId <> '') AS n_clean "
        "FROM (SELECT *, itemInSession = 13 AND ts % 7 = 0 AS broken FROM activity)"
    ),
)
def q_log_line_counts(spark, d):
    """S-1 / P-2: counts of a raw JSON-lines log in which some lines are cut off."""
    from ..session import scratch_path
    from ..sources.schema import line_counts

    path = scratch_path(spark, f"log_lines/{uuid.uuid4().hex}")
    a = raw(spark, d)
    line = F.to_json(F.struct(*a.columns))
    broken = (F.col("itemInSession") == 13) & (F.col("ts") % 7 == 0)
    a.select(F.when(broken, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(path)
    return line_counts(spark.read.text(path))


# ---------------------------------------------------------------- distinct counts, users by


@register("distinct_users", sql("SELECT count(DISTINCT userId) AS unique_users FROM clean", *CLEAN_CTES))
def q_distinct_users(spark, d):
    return PR.distinct_count(clean(spark, d), "userId", "unique_users")


@register("distinct_items", sql("SELECT count(DISTINCT itemInSession) AS count_items FROM clean", *CLEAN_CTES))
def q_distinct_items(spark, d):
    return PR.distinct_count(clean(spark, d), "itemInSession", "count_items")


@register("distinct_agents", sql("SELECT count(DISTINCT userAgent) AS n_agents FROM clean", *CLEAN_CTES))
def q_distinct_agents(spark, d):
    return PR.distinct_count(clean(spark, d), "userAgent", "n_agents")


for _dim, _key in [("auth", "auth"), ("gender", "gender"), ("level", "level"), ("location", "location"), ("agent", "userAgent")]:

    def _users_by(spark, d, _key=_key):
        return PR.users_by(clean(spark, d), [_key])

    register(
        f"users_by_{_dim}",
        sql(f"SELECT {_key}, count(DISTINCT userId) AS count_users FROM clean GROUP BY {_key}", *CLEAN_CTES),
    )(_users_by)


@register("events_by_page", sql("SELECT page, count(userId) AS count_users FROM clean GROUP BY page", *CLEAN_CTES))
def q_events_by_page(spark, d):
    return PR.events_by(clean(spark, d), ["page"])


def _rollup_sql(fine: str, coarse_sql: str, name: str) -> str:
    return sql(
        f"SELECT {name}, CAST(sum(count_users) AS BIGINT) AS count_users FROM ("
        f"SELECT {coarse_sql} AS {name}, count_users FROM ("
        f"SELECT {fine}, count(DISTINCT userId) AS count_users FROM clean GROUP BY {fine})) "
        f"WHERE {name} IS NOT NULL GROUP BY {name}",
        *CLEAN_CTES,
    )


BROWSER_SQL = (
    "CASE WHEN {x} LIKE '%Firefox%' THEN 'Firefox' WHEN {x} LIKE '%Safari%' AND {x} LIKE '%Chrome%' THEN 'Chrome' "
    "WHEN {x} LIKE '%Safari%' THEN 'Safari' WHEN {x} LIKE '%Trident%' THEN 'IE' END"
)
PLATFORM_SQL = (
    "CASE split_part(regexp_extract({x}, '\\(([^\\)]*)\\)', 1), ';', 1) "
    "WHEN 'compatible' THEN 'Windows' WHEN 'iPad' THEN 'iPad' WHEN 'iPhone' THEN 'iPhone' WHEN 'Macintosh' THEN 'Mac' "
    "WHEN 'Windows NT 5.1' THEN 'Windows' WHEN 'Windows NT 6.0' THEN 'Windows' WHEN 'Windows NT 6.1' THEN 'Windows' "
    "WHEN 'Windows NT 6.2' THEN 'Windows' WHEN 'Windows NT 6.3' THEN 'Windows' WHEN 'X11' THEN 'Linux' END"
)


@register("state_rollup", _rollup_sql("location", STATE_SQL.format(x="location"), "state"))
def q_state_rollup(spark, d):
    return PR.rolled_up_users(clean(spark, d), "location", X.state_group("location"), "state")


@register("browser_rollup", _rollup_sql("userAgent", BROWSER_SQL.format(x="userAgent"), "browser"))
def q_browser_rollup(spark, d):
    return PR.rolled_up_users(clean(spark, d), "userAgent", X.browser("userAgent"), "browser")


@register("platform_rollup", _rollup_sql("userAgent", PLATFORM_SQL.format(x="userAgent"), "platform"))
def q_platform_rollup(spark, d):
    return PR.rolled_up_users(clean(spark, d), "userAgent", X.platform("userAgent"), "platform")


for _part, _expr in [("weekday", "dayname(t)"), ("day", "day"), ("hour", "hour")]:

    def _by_time(spark, d, _part=_part):
        return PR.events_by_time(clean(spark, d), _part)

    register(
        f"events_by_{_part}",
        sql(f"SELECT {_expr} AS {_part}, count(userId) AS n_events FROM clean GROUP BY 1", *CLEAN_CTES),
    )(_by_time)


@register(
    "level_changers",
    sql(
        "SELECT count(*) AS n_users FROM (SELECT userId FROM clean GROUP BY userId HAVING count(DISTINCT level) > 1)",
        *CLEAN_CTES,
    ),
)
def q_level_changers(spark, d):
    return PR.level_changers(clean(spark, d))


@register(
    "length_histogram",
    sql(
        "SELECT b.bin, lo + b.bin * w AS bin_start, lo + (b.bin + 1) * w AS bin_end, coalesce(n, 0) AS n FROM "
        "(SELECT CAST(unnest(range(20)) AS INTEGER) AS bin) b CROSS JOIN s LEFT JOIN ("
        "SELECT least(CAST(floor((length - lo) / w) AS INTEGER), 19) AS bin, count(*) AS n FROM clean, s WHERE length IS NOT NULL GROUP BY 1) c "
        "ON b.bin = c.bin",
        *CLEAN_CTES,
        "s AS (SELECT min(length) AS lo, (max(length) - min(length)) / CAST(20 AS DOUBLE) AS w FROM clean)",
    ),
)
def q_length_histogram(spark, d):
    return PR.histogram(clean(spark, d), "length", 20)


@register(
    "timeline",
    sql("SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS datetime, userId FROM clean", *CLEAN_CTES),
)
def q_timeline(spark, d):
    return PR.timeline(clean(spark, d))


@register(
    "timeline_tail",
    sql(
        "SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS datetime, userId FROM clean ORDER BY datetime DESC, userId DESC LIMIT 10",
        *CLEAN_CTES,
    ),
)
def q_timeline_tail(spark, d):
    return PR.preview(PR.timeline(clean(spark, d)), 10, [F.desc("datetime"), F.desc("userId")])


@register(
    "top_locations",
    sql(
        "SELECT location, count(DISTINCT userId) AS count_users FROM clean GROUP BY location "
        "ORDER BY count_users DESC, location NULLS FIRST LIMIT 5",
        *CLEAN_CTES,
    ),
)
def q_top_locations(spark, d):
    return PR.top_k(PR.users_by(clean(spark, d), ["location"]), "count_users", 5, ["location"])


@register(
    "top_agents",
    sql(
        "SELECT userAgent, count(DISTINCT userId) AS count_users FROM clean GROUP BY userAgent "
        "ORDER BY count_users DESC, userAgent LIMIT 5",
        *CLEAN_CTES,
    ),
)
def q_top_agents(spark, d):
    return PR.top_k(PR.users_by(clean(spark, d), ["userAgent"]), "count_users", 5, ["userAgent"])


@register("distinct_pages", sql("SELECT DISTINCT page FROM clean", *CLEAN_CTES))
def q_distinct_pages(spark, d):
    return PR.distinct_values(clean(spark, d), "page")


@register("distinct_auth", sql("SELECT DISTINCT auth FROM clean", *CLEAN_CTES))
def q_distinct_auth(spark, d):
    return PR.distinct_values(clean(spark, d), "auth")


# ---------------------------------------------------------------- scalar functions


@register(
    "event_dates",
    sql("SELECT userId, ts, date, strftime(t, '%Y-%m-%d %H:%M:%S') AS datetime FROM clean", *CLEAN_CTES),
)
def q_event_dates(spark, d):
    return clean(spark, d).select("userId", "ts", X.event_date("ts").alias("date"), X.event_datetime("ts").alias("datetime"))


@register(
    "time_parts",
    sql("SELECT userId, ts, hour, day, weekday, dayname(t) AS weekday_name FROM clean", *CLEAN_CTES),
)
def q_time_parts(spark, d):
    return clean(spark, d).select(
        "userId",
        "ts",
        X.hour_of("ts").alias("hour"),
        X.day_of("ts").alias("day"),
        X.weekday_of("ts").alias("weekday"),
        X.weekday_name("ts").alias("weekday_name"),
    )


@register(
    "state_codes",
    sql(f"SELECT DISTINCT location, {CODE_SQL.format(x='location')} AS state_code FROM clean", *CLEAN_CTES),
)
def q_state_codes(spark, d):
    return clean(spark, d).select("location").distinct().select("location", X.state_code("location").alias("state_code"))


@register(
    "city_state",
    sql(
        f"SELECT DISTINCT location, split_part(location, ',', 1) AS city, {STATE_SQL.format(x='location')} AS state FROM clean",
        *CLEAN_CTES,
    ),
)
def q_city_state(spark, d):
    locs = clean(spark, d).select("location").distinct()
    return locs.select("location", X.city("location").alias("city"), X.state_group("location").alias("state"))


@register("browsers", sql(f"SELECT DISTINCT userAgent, {BROWSER_SQL.format(x='userAgent')} AS browser FROM clean", *CLEAN_CTES))
def q_browsers(spark, d):
    return clean(spark, d).select("userAgent").distinct().select("userAgent", X.browser("userAgent").alias("browser"))


@register(
    "platforms", sql(f"SELECT DISTINCT userAgent, {PLATFORM_SQL.format(x='userAgent')} AS platform FROM clean", *CLEAN_CTES)
)
def q_platforms(spark, d):
    return clean(spark, d).select("userAgent").distinct().select("userAgent", X.platform("userAgent").alias("platform"))


@register(
    "days_active",
    sql(
        "SELECT userId, min(date) AS first_date, "
        f"CAST(date_diff('day', CAST(min(date) AS DATE), DATE '{AS_OF}') AS INTEGER) AS days_active "
        "FROM clean GROUP BY userId",
        *CLEAN_CTES,
    ),
)
def q_days_active(spark, d):
    first = clean(spark, d).groupBy("userId").agg(F.min(X.event_date("ts")).alias("first_date"))
    return first.withColumn("days_active", X.days_active("first_date", AS_OF))


# ---------------------------------------------------------------- churn label and windows


@register("churn_labels", sql("SELECT userId, churn FROM labels", *LABEL_CTES))
def q_churn_labels(spark, d):
    return CH.churn_labels(clean(spark, d))


@register(
    "churn_flag",
    sql(
        "SELECT userId, ts, page, MAX(CASE WHEN page = 'Cancellation Confirmation' THEN 1 ELSE 0 END) "
        "OVER (PARTITION BY userId) AS Churn FROM clean",
        *CLEAN_CTES,
    ),
)
def q_churn_flag(spark, d):
    return CH.with_churn(clean(spark, d).select("userId", "ts", "page"))


@register(
    "user_span",
    sql(
        "SELECT userId, sessionId, itemInSession, ts, min(ts) OVER (PARTITION BY userId) AS first_ts, "
        "max(ts) OVER (PARTITION BY userId) AS last_ts FROM clean",
        *CLEAN_CTES,
    ),
)
def q_user_span(spark, d):
    return CH.with_user_span(clean(spark, d).select("userId", "sessionId", "itemInSession", "ts"))


def _bucketed(spark, a: DataFrame, subs: int) -> DataFrame:
    from ..sources.buckets import write_user_buckets

    return write_user_buckets(a, "events_by_user", int(spark.conf.get("spark.sql.shuffle.partitions")), subs)


@register("churn_flag_bucketed", ORACLES["churn_flag"])
def q_churn_flag_bucketed(spark, d):
    """W-5 / J-5 on a table bucketed by user: neither the flag nor its spread moves events."""
    from ..sources.buckets import spread

    events = _bucketed(spark, clean(spark, d).select("userId", "ts", "page"), 1)
    return spread(events, CH.churn_labels(events, "Churn"))


@register("user_span_bucketed", ORACLES["user_span"])
def q_user_span_bucketed(spark, d):
    """W-1 on a table whose users are split over four sub-buckets each."""
    from ..sources.buckets import spread

    events = _bucketed(spark, clean(spark, d).select("userId", "sessionId", "itemInSession", "ts"), 4)
    return spread(events, CH.user_span(events), 4)


@register(
    "daily_counts",
    sql("SELECT userId, ts, date, count(*) OVER (PARTITION BY userId, date) AS events FROM clean", *CLEAN_CTES),
)
def q_daily_counts(spark, d):
    return CH.with_daily_count(clean(spark, d).select("userId", "ts")).select("userId", "ts", "date", "events")


@register(
    "user_counts",
    sql(
        "SELECT userId, ts, count(*) OVER (PARTITION BY userId) AS n FROM clean WHERE page = 'Thumbs Up'",
        *CLEAN_CTES,
    ),
)
def q_user_counts(spark, d):
    return CH.with_user_count(clean(spark, d).select("userId", "ts", "page"), "Thumbs Up").select("userId", "ts", "n")


@register(
    "last_values",
    sql("SELECT userId, ts AS last_ts, level AS last_level, location AS last_location FROM latest", *CLEAN_CTES, LATEST),
)
def q_last_values(spark, d):
    return CH.last_values(clean(spark, d), ["level", "location"])


@register(
    "latest_per_user",
    sql(
        "SELECT userId, sessionId, itemInSession, ts, page, auth, level, gender, location, userAgent, song, artist, length "
        "FROM latest",
        *CLEAN_CTES,
        LATEST,
    ),
)
def q_latest_per_user(spark, d):
    return CH.latest_per_user(clean(spark, d))


@register(
    "latest_per_user_gender",
    sql(
        "SELECT userId, gender, ts, page, level FROM (SELECT c.*, ROW_NUMBER() OVER (PARTITION BY userId, gender "
        "ORDER BY ts DESC, sessionId DESC, itemInSession DESC, page DESC, level DESC) AS rn FROM clean c) WHERE rn = 1",
        *CLEAN_CTES,
    ),
)
def q_latest_per_user_gender(spark, d):
    """D-3 by (userId, gender)."""
    return CH.latest_per_user(clean(spark, d), ["page", "level"], keys=["userId", "gender"]).select("userId", "gender", "ts", "page", "level")


@register(
    "mapped_levels",
    sql("SELECT userId, ts, CASE level WHEN 'free' THEN '0' WHEN 'paid' THEN '1' ELSE level END AS level FROM clean", *CLEAN_CTES),
)
def q_mapped_levels(spark, d):
    """P-11: values of a column replaced by a mapping."""
    return CL.map_values(clean(spark, d).select("userId", "ts", "level"), "level", {"free": "0", "paid": "1"})


# ---------------------------------------------------------------- crosstabs


@register("churn_counts", sql("SELECT churn, count(*) AS n_users FROM labels GROUP BY churn", *LABEL_CTES))
def q_churn_counts(spark, d):
    return CT.label_balance(CH.churn_labels(clean(spark, d)))


@register(
    "length_by_churn",
    sql(
        "SELECT churn, round(avg(length), 6) AS mean_length, round(stddev_samp(length), 6) AS stddev_length, "
        "min(length) AS minimum_length, max(length) AS maximum_length "
        "FROM clean JOIN labels USING (userId) WHERE length IS NOT NULL GROUP BY churn",
        *LABEL_CTES,
    ),
)
def q_length_by_churn(spark, d):
    return rounded(CT.length_by_churn(clean(spark, d)), ["mean_length", "stddev_length"])


USER_DIMS = {
    "auth": ("auth", lambda: F.col("auth")),
    "gender": ("gender", lambda: F.col("gender")),
    "level": ("level", lambda: F.col("level")),
    "city": ("split_part(location, ',', 1)", lambda: X.city("location")),
    "state": (STATE_SQL.format(x="location"), lambda: X.state_group("location")),
}
EVENT_DIMS = {
    "page": ("page", lambda: F.col("page")),
    "browser": ("browser", lambda: X.browser("userAgent")),
    "platform": ("platform", lambda: X.platform("userAgent")),
    "hour": ("hour", lambda: X.hour_of("ts")),
    "day": ("day", lambda: X.day_of("ts")),
    "weekday": ("weekday", lambda: X.weekday_of("ts")),
}


def _user_ct_sql(expr: str, name: str) -> str:
    return (
        f"SELECT l.churn, {expr} AS {name}, count(*) AS count FROM latest x JOIN labels l USING (userId) GROUP BY 1, 2"
    )


def _event_ct_sql(name: str) -> str:
    return f"SELECT churn, {name}, count(*) AS count FROM dims GROUP BY churn, {name}"


def _scaled_sql(ct_sql: str, name: str) -> str:
    return (
        f"SELECT {name}, 0 AS churn, (c0 - lo0) / (hi0 - lo0) AS scaled FROM wide, rng WHERE hi0 > lo0 "
        f"UNION ALL SELECT {name}, 1 AS churn, (c1 - lo1) / (hi1 - lo1) AS scaled FROM wide, rng WHERE hi1 > lo1"
    ), (
        f"ct AS ({ct_sql})",
        f"wide AS (SELECT {name}, coalesce(sum(count) FILTER (WHERE churn = 0), 0) AS c0, "
        f"coalesce(sum(count) FILTER (WHERE churn = 1), 0) AS c1 FROM ct GROUP BY {name})",
        "rng AS (SELECT min(c0) AS lo0, max(c0) AS hi0, min(c1) AS lo1, max(c1) AS hi1 FROM wide)",
    )


for _name, (_sql_expr, _col) in USER_DIMS.items():

    def _churn_by(spark, d, _name=_name, _col=_col):
        return CT.user_crosstab(clean(spark, d), _col(), _name)

    register(f"churn_by_{_name}", sql(_user_ct_sql(_sql_expr, _name), *LABEL_CTES, LATEST))(_churn_by)

for _name in ["city", "state"]:
    _sql_expr, _col = USER_DIMS[_name]
    _body, _extra = _scaled_sql(_user_ct_sql(_sql_expr, _name), _name)

    def _scaled_user(spark, d, _name=_name, _col=_col):
        return CT.scaled_crosstab(CT.user_crosstab(clean(spark, d), _col(), _name), _name, classes=[0, 1])

    register(f"scaled_{_name}", sql(_body, *LABEL_CTES, LATEST, *_extra))(_scaled_user)

for _name, (_sql_expr, _mk) in EVENT_DIMS.items():

    def _events_by_churn(spark, d, _name=_name, _mk=_mk):
        return CT.event_crosstab(clean(spark, d), _mk(), _name)

    register(f"events_by_churn_{_name}", sql(_event_ct_sql(_sql_expr), *DIM_CTES))(_events_by_churn)
    _body, _extra = _scaled_sql(_event_ct_sql(_sql_expr), _name)

    def _scaled_event(spark, d, _name=_name, _mk=_mk):
        return CT.scaled_crosstab(CT.event_crosstab(clean(spark, d), _mk(), _name), _name, classes=[0, 1])

    register(f"scaled_{_name}", sql(_body, *DIM_CTES, *_extra))(_scaled_event)


def _ztest_sql(col: str) -> str:
    """The p-value by Simpson's rule over the normal density from 0 to abs(z)."""
    return sql(
        "SELECT group_a, n_a, churned_a, group_b, n_b, churned_b, round(z, 6) AS z, "
        "round(1 - 2 * (SELECT sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END "
        "* exp(-(i * abs(z) / 2000) * (i * abs(z) / 2000) / 2) / sqrt(2 * pi())) * abs(z) / 6000 "
        "FROM (SELECT unnest(range(2001)) AS i)), 6) AS p_value FROM t",
        *LABEL_CTES,
        LATEST,
        f"g AS (SELECT x.{col} AS g, count(*) AS n, CAST(sum(l.churn) AS BIGINT) AS x FROM latest x JOIN labels l USING (userId) GROUP BY 1)",
        "t AS (SELECT a.g AS group_a, a.n AS n_a, a.x AS churned_a, b.g AS group_b, b.n AS n_b, b.x AS churned_b, "
        "(CAST(a.x AS DOUBLE) / a.n - CAST(b.x AS DOUBLE) / b.n) / sqrt(((CAST(a.x AS DOUBLE) + b.x) / (a.n + b.n)) "
        "* (1 - (CAST(a.x AS DOUBLE) + b.x) / (a.n + b.n)) * (1 / CAST(a.n AS DOUBLE) + 1 / CAST(b.n AS DOUBLE))) AS z "
        "FROM g a JOIN g b ON a.g < b.g)",
    )


for _col in ["gender", "level"]:

    def _ztest(spark, d, _col=_col):
        users = CT.user_latest_with_churn(clean(spark, d), [_col])
        return rounded(CT.ztest_counts(users, _col), ["z", "p_value"])

    register(f"ztest_{_col}", _ztest_sql(_col))(_ztest)


# ---------------------------------------------------------------- per-user features

PAGE_COLS_SQL = ", ".join(f"count(*) FILTER (WHERE page = '{p}') AS \"{p}\"" for p in O.PAGES)
PAGE_SUM_SQL = " + ".join(f"count(*) FILTER (WHERE page = '{p}')" for p in O.PAGES)


@register(
    "user_length_stats",
    sql(
        "SELECT userId, round(avg(length), 6) AS average_length, round(stddev_samp(length), 6) AS stddev_length, "
        "max(length) AS max_length, min(length) AS min_length FROM clean GROUP BY userId",
        *CLEAN_CTES,
    ),
)
def q_user_length_stats(spark, d):
    return rounded(FE.user_length_stats(clean(spark, d)), ["average_length", "stddev_length"])


@register(
    "page_pivot",
    sql(f"SELECT userId, {PAGE_COLS_SQL}, {PAGE_SUM_SQL} AS sum_pages FROM clean GROUP BY userId", *CLEAN_CTES),
)
def q_page_pivot(spark, d):
    return FE.page_pivot(clean(spark, d))


PLAYS_SQL = (
    "songs_u AS (SELECT userId, count(*) AS unique_songs FROM (SELECT DISTINCT userId, song FROM clean WHERE page = 'NextSong') GROUP BY userId), "
    "songs_t AS (SELECT userId, count(*) AS total_songs FROM clean WHERE page = 'NextSong' GROUP BY userId), "
    "artists_u AS (SELECT userId, count(*) AS unique_artists FROM (SELECT DISTINCT userId, artist FROM clean WHERE page = 'NextSong') GROUP BY userId)"
)


@register(
    "play_counts",
    sql(
        "SELECT userId, total_songs, unique_songs, unique_artists FROM songs_t JOIN songs_u USING (userId) JOIN artists_u USING (userId)",
        *CLEAN_CTES,
        PLAYS_SQL,
    ),
)
def q_play_counts(spark, d):
    return FE.play_counts(clean(spark, d))


SHARES_SQL = (
    "tot AS (SELECT userId, count(*) AS total_count FROM clean GROUP BY userId), "
    "dcount AS (SELECT userId, count(*) AS day_count FROM clean WHERE day <= 15 GROUP BY userId), "
    "hcount AS (SELECT userId, count(*) AS hourofday_count FROM clean WHERE hour > 12 GROUP BY userId), "
    "month_share AS (SELECT userId, day_count / total_count AS month_percentage FROM tot JOIN dcount USING (userId)), "
    "hour_share AS (SELECT userId, hourofday_count / total_count AS hour_percentage FROM tot JOIN hcount USING (userId))"
)


@register("month_share", sql("SELECT * FROM month_share", *CLEAN_CTES, SHARES_SQL))
def q_month_share(spark, d):
    return FE.share_of_events(clean(spark, d), CL.in_first_half_of_month(), "month_percentage")


@register("hour_share", sql("SELECT * FROM hour_share", *CLEAN_CTES, SHARES_SQL))
def q_hour_share(spark, d):
    return FE.share_of_events(clean(spark, d), CL.after_noon_hour(), "hour_percentage")


DAILY_SQL = (
    "ev AS (SELECT userId, round(avg(n), 2) AS avg_events FROM (SELECT userId, date, count(*) AS n FROM clean GROUP BY 1, 2) GROUP BY 1), "
    "so AS (SELECT userId, round(avg(n), 2) AS avg_songs FROM (SELECT userId, date, count(*) AS n FROM clean WHERE page = 'NextSong' GROUP BY 1, 2) GROUP BY 1)"
)


@register("avg_events", sql("SELECT * FROM ev", *CLEAN_CTES, DAILY_SQL))
def q_avg_events(spark, d):
    return FE.avg_per_active_day(clean(spark, d), None, "avg_events")


@register("avg_songs", sql("SELECT * FROM so", *CLEAN_CTES, DAILY_SQL))
def q_avg_songs(spark, d):
    return FE.avg_per_active_day(clean(spark, d), X.PLAY_PAGE, "avg_songs")


for _key, _page, _out in [
    ("thumbs_up", "Thumbs Up", "thumbs_up"),
    ("thumbs_down", "Thumbs Down", "thumbs_down"),
    ("add_friends", "Add Friend", "addfriend"),
]:

    def _page_count(spark, d, _page=_page, _out=_out):
        return FE.page_count(clean(spark, d), _page, _out)

    register(
        _key, sql(f"SELECT userId, count(*) AS {_out} FROM clean WHERE page = '{_page}' GROUP BY userId", *CLEAN_CTES)
    )(_page_count)


BEHAVIOUR_SQL = (
    "firsts AS (SELECT userId, min(date) AS first_date FROM clean GROUP BY userId), "
    "ft AS (SELECT DISTINCT x.userId, x.gender, l.churn, x.level AS last_level, "
    f"CAST(date_diff('day', CAST(f.first_date AS DATE), DATE '{AS_OF}') AS INTEGER) AS days_active, "
    f"{CODE_SQL.format(x='x.location')} AS last_state "
    "FROM latest x JOIN labels l USING (userId) JOIN firsts f USING (userId) "
    "WHERE x.gender IS NOT NULL AND x.level IS NOT NULL AND x.location IS NOT NULL), "
    "tu AS (SELECT userId, count(*) AS thumbs_up FROM clean WHERE page = 'Thumbs Up' GROUP BY userId), "
    "td AS (SELECT userId, count(*) AS thumbs_down FROM clean WHERE page = 'Thumbs Down' GROUP BY userId), "
    "af AS (SELECT userId, count(*) AS addfriend FROM clean WHERE page = 'Add Friend' GROUP BY userId), "
    "bf AS (SELECT ft.userId, ft.gender, ft.churn, ft.last_level, ft.days_active, ft.last_state, so.avg_songs, ev.avg_events, "
    "coalesce(tu.thumbs_up, 0) AS thumbs_up, coalesce(td.thumbs_down, 0) AS thumbs_down, coalesce(af.addfriend, 0) AS addfriend "
    "FROM ft JOIN so USING (userId) JOIN ev USING (userId) LEFT JOIN tu USING (userId) LEFT JOIN td USING (userId) "
    "LEFT JOIN af USING (userId))"
)
BF_CTES = (*LABEL_CTES, LATEST, DAILY_SQL, BEHAVIOUR_SQL)


@register("behaviour_features", sql("SELECT * FROM bf", *BF_CTES))
def q_behaviour_features(spark, d):
    return FE.behaviour_features(raw(spark, d), AS_OF)


def _dict_sql(col: str, src: str = "dims") -> str:
    return (
        f"SELECT '{col}' AS column, v AS value, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS code "
        f"FROM (SELECT DISTINCT {col} AS v FROM {src} WHERE {col} IS NOT NULL)"
    )


CODES_SQL = "codes AS (" + " UNION ALL ".join(_dict_sql(c) for c in O.CATEGORIES) + ")"
LATEST_DIMS_SQL = (
    "ldims AS (SELECT * FROM (SELECT d.*, ROW_NUMBER() OVER (PARTITION BY userId ORDER BY ts DESC, sessionId DESC, "
    "itemInSession DESC, page DESC, level DESC) AS rn2 FROM dims d) WHERE rn2 = 1)"
)
CATEGORICAL_SQL = (
    "cat AS (SELECT x.userId, "
    + ", ".join(
        f"(SELECT code FROM codes WHERE \"column\" = '{c}' AND value = x.{c}) AS {c}" for c in O.CATEGORIES
    )
    + " FROM ldims x)"
)
CAT_CTES = (*DIM_CTES, CODES_SQL, LATEST_DIMS_SQL, CATEGORICAL_SQL)


@register("label_encoding", sql("SELECT * FROM codes", *DIM_CTES, CODES_SQL))
def q_label_encoding(spark, d):
    return FE.label_dictionary(clean(spark, d))


@register("categorical_features", sql("SELECT * FROM cat", *CAT_CTES))
def q_categorical_features(spark, d):
    return FE.categorical_features(raw(spark, d))


NUM_COLS_SQL = (
    "average_length, stddev_length, max_length, min_length, "
    + ", ".join(f'"{p}"' for p in O.PAGES)
    + ", sum_pages, unique_songs, total_songs, unique_artists, month_percentage, hour_percentage"
)
NUMERICAL_SQL = (
    "flen AS (SELECT userId, avg(length) AS average_length, stddev_samp(length) AS stddev_length, "
    "max(length) AS max_length, min(length) AS min_length FROM clean GROUP BY userId), "
    f"fpage AS (SELECT userId, {PAGE_COLS_SQL}, {PAGE_SUM_SQL} AS sum_pages FROM clean GROUP BY userId), "
    f"{PLAYS_SQL}, {SHARES_SQL}, "
    f"num AS (SELECT userId, {NUM_COLS_SQL} FROM flen JOIN fpage USING (userId) JOIN songs_u USING (userId) "
    "JOIN songs_t USING (userId) JOIN artists_u USING (userId) JOIN month_share USING (userId) JOIN hour_share USING (userId))"
)
NUM_CTES = (*CLEAN_CTES, NUMERICAL_SQL)


@register(
    "numerical_features",
    sql(
        "SELECT * REPLACE (round(average_length, 6) AS average_length, round(stddev_length, 6) AS stddev_length) FROM num",
        *NUM_CTES,
    ),
)
def q_numerical_features(spark, d):
    return rounded(FE.numerical_features(raw(spark, d)), ["average_length", "stddev_length"])


TRAINING_SQL = (
    "train AS (SELECT userId, "
    + ", ".join(f"coalesce(CAST({c} AS INTEGER), 0) AS {c}" for c in O.CATEGORIES)
    + ", "
    + ", ".join(f'coalesce(CAST("{c}" AS FLOAT), 0) AS "{c}"' for c in O.NUMBERS)
    + ", CAST(churn AS INTEGER) AS Churn FROM cat JOIN num USING (userId) JOIN labels USING (userId))"
)
TRAIN_CTES = (*CAT_CTES, NUMERICAL_SQL, TRAINING_SQL)


@register("training_set", sql("SELECT * FROM train", *TRAIN_CTES))
def q_training_set(spark, d):
    return FE.training_set(raw(spark, d))


@register("feature_round_trip", sql("SELECT * FROM train", *TRAIN_CTES))
def q_feature_round_trip(spark, d):
    """S-2 / S-3: the training table written to the shared folder and read back
    with its declared schema and column order."""
    from ..session import scratch_path
    from ..sources.schema import read_features, write_features

    path = scratch_path(spark, f"training_set/{zlib.crc32(d.encode())}/{uuid.uuid4().hex}")
    write_features(FE.training_set(raw(spark, d)), path, "json")
    return read_features(spark, path, "json")


# ---------------------------------------------------------------- ML transforms and metrics
# (imported late: the ML classes load only when these queries are used)

from . import ml as ML  # noqa: E402
from . import score as SC  # noqa: E402


def batch_features(spark, d) -> DataFrame:
    return FE.behaviour_features(raw(spark, d), AS_OF)


def written_batch_features(spark, d) -> DataFrame:
    """The batch feature table written once to the shared folder, for ML
    stages that fit and then transform (each pass would otherwise re-run the
    feature job over the events)."""
    return ML.materialize(batch_features(spark, d), f"behaviour_features/{zlib.crc32(d.encode())}")


def _index_sql(col: str, alias: str) -> str:
    return (
        f"{alias} AS (SELECT {col} AS v, row_number() OVER (ORDER BY count(*) DESC, {col}) - 1 AS idx, "
        f"count(*) OVER () AS n_labels FROM bf GROUP BY {col})"
    )


INDEX_SQL = ", ".join(_index_sql(c, a) for c, a in [("gender", "gi"), ("last_level", "li"), ("last_state", "si")])
VEC_SQL = (
    "vec AS (SELECT b.*, gi.idx AS g, gi.n_labels AS ng, li.idx AS l, li.n_labels AS nl, si.idx AS s, si.n_labels AS ns, "
    "CAST(3 AS DOUBLE) + days_active + avg_songs + avg_events + thumbs_up + thumbs_down + addfriend AS norm "
    "FROM bf b JOIN gi ON b.gender = gi.v JOIN li ON b.last_level = li.v JOIN si ON b.last_state = si.v)"
)
ML_CTES = (*BF_CTES, INDEX_SQL, VEC_SQL)


@register(
    "indexed_categories",
    sql(
        "SELECT userId, CAST(g AS DOUBLE) AS genderIndex, CAST(l AS DOUBLE) AS levelIndex, CAST(s AS DOUBLE) AS stateIndex FROM vec",
        *ML_CTES,
    ),
)
def q_indexed_categories(spark, d):
    return ML.index_categories(written_batch_features(spark, d)).select("userId", *ML.BATCH_INDEXED)


@register(
    "one_hot_slots",
    sql(
        "SELECT userId, CAST(g AS INTEGER) AS gender_slot, CAST(ng AS INTEGER) AS gender_size, "
        "CAST(l AS INTEGER) AS level_slot, CAST(nl AS INTEGER) AS level_size, "
        "CAST(s AS INTEGER) AS state_slot, CAST(ns AS INTEGER) AS state_size FROM vec",
        *ML_CTES,
    ),
)
def q_one_hot_slots(spark, d):
    enc = ML.one_hot(written_batch_features(spark, d))
    cols = {}
    for name, vec in zip(["gender", "level", "state"], ML.BATCH_ONE_HOT):
        arr = ML.vector_to_array(vec)
        cols[f"{name}_slot"] = (F.array_position(arr, 1.0) - 1).cast("int")
        cols[f"{name}_size"] = F.size(arr).cast("int")
    return enc.select("userId", *[v.alias(k) for k, v in cols.items()])


_L1_PARTS = [("1", "g"), ("1", "ng + l"), ("1", "ng + nl + s")] + [
    (c, f"ng + nl + ns + {i}") for i, c in enumerate(ML.BATCH_NUMERIC)
]


@register(
    "l1_features",
    sql(
        " UNION ALL ".join(
            f"SELECT userId, CAST({slot} AS INTEGER) AS slot, round({x} / norm, 9) AS value FROM vec"
            + ("" if x == "1" else f" WHERE {x} <> 0")
            for x, slot in _L1_PARTS
        ),
        *ML_CTES,
    ),
)
def q_l1_features(spark, d):
    entries = ML.nonzero_entries(ML.l1_features(written_batch_features(spark, d)), "features")
    return entries.withColumn("value", F.round("value", 9))


N_SCALED = len(O.CATEGORIES) + len(O.NUMBERS)
_STATS_SQL = "st AS (SELECT " + ", ".join(
    f'avg(CAST("{c}" AS DOUBLE)) AS m{i}, stddev_samp(CAST("{c}" AS DOUBLE)) AS s{i}'
    for i, c in enumerate(O.NUMBERS)
) + " FROM train)"
_SCALED_COLS_SQL = ", ".join(
    [f"CAST({c} AS DOUBLE) AS f_{i:02d}" for i, c in enumerate(O.CATEGORIES)]
    + [
        f'round(CASE WHEN s{i} = 0 THEN 0 ELSE (CAST("{c}" AS DOUBLE) - m{i}) / s{i} END, 6) + CAST(0 AS DOUBLE) '
        f"AS f_{i + len(O.CATEGORIES):02d}"
        for i, c in enumerate(O.NUMBERS)
    ]
)


@register(
    "scaled_features",
    sql(f"SELECT userId, CAST(Churn AS DOUBLE) AS label, {_SCALED_COLS_SQL} FROM train, st", *TRAIN_CTES, _STATS_SQL),
)
def q_scaled_features(spark, d):
    # training_set already reads a per-user table written once; what remains
    # is a projection and an encoding, cheap to repeat for the scaler's passes
    t = ML.scaled_training_set(FE.training_set(raw(spark, d)), keep_key=True)
    arr = ML.vector_to_array("features")
    return t.select(
        "userId",
        "label",
        *[(F.round(arr[i], DIGITS) + F.lit(0.0)).alias(f"f_{i:02d}") for i in range(N_SCALED)],
    )


def rule_predictions(bf: DataFrame) -> DataFrame:
    """A fixed, data-derived prediction table to check the metric function:
    predict churn for users whose last level is free."""
    return bf.select(
        F.col("churn").cast("double").alias("label"),
        F.when(F.col("last_level") == "free", 1.0).otherwise(0.0).alias("prediction"),
    )


@register(
    "confusion_and_f1",
    sql(
        "SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(tp) / sum(n), 9) AS accuracy, "
        "round(sum(prec * n) / sum(n), 9) AS weighted_precision, round(sum(rec * n) / sum(n), 9) AS weighted_recall, "
        "round(sum(f1 * n) / sum(n), 9) AS weighted_f1 FROM m2",
        *BF_CTES,
        "conf AS (SELECT CAST(churn AS DOUBLE) AS l, CASE WHEN last_level = 'free' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS p, "
        "CAST(count(*) AS DOUBLE) AS w FROM bf GROUP BY 1, 2), "
        "pl AS (SELECT l, sum(w) AS n, sum(CASE WHEN l = p THEN w ELSE 0 END) AS tp FROM conf GROUP BY l), "
        "pp AS (SELECT p AS l, sum(CASE WHEN l <> p THEN w ELSE 0 END) AS fp FROM conf GROUP BY p), "
        "m AS (SELECT pl.l, n, tp, coalesce(fp, 0) AS fp, CASE WHEN tp + coalesce(fp, 0) = 0 THEN 0 "
        "ELSE tp / (tp + coalesce(fp, 0)) END AS prec, tp / n AS rec FROM pl LEFT JOIN pp USING (l)), "
        "m2 AS (SELECT *, CASE WHEN prec + rec = 0 THEN 0 ELSE 2 * prec * rec / (prec + rec) END AS f1 FROM m)",
    ),
)
def q_confusion_and_f1(spark, d):
    m = ML.evaluate(rule_predictions(batch_features(spark, d)))
    return rounded(m, ["accuracy", "weighted_precision", "weighted_recall", "weighted_f1"], 9)


MD5_SPLIT_SQL = (
    "spl AS (SELECT *, CASE WHEN u < 6 THEN 'train' WHEN u < 8 THEN 'test' ELSE 'validation' END AS split "
    "FROM (SELECT *, ascii(substr(md5(userId), 1, 1)) % 10 AS u FROM bf))"
)


def md5_split(bf: DataFrame) -> DataFrame:
    """A split by a hash that other engines have too (first hex digit of the md5 of the user)."""
    u = F.ascii(F.substring(F.md5(F.col("userId").cast("binary")), 1, 1)) % 10
    return bf.withColumn("split", F.when(u < 6, F.lit(0)).when(u < 8, F.lit(1)).otherwise(F.lit(2)))


@register(
    "split_sizes",
    sql(
        "SELECT split, count(*) AS n_rows, count(DISTINCT userId) AS n_users, "
        "count(*) FILTER (WHERE userId IN (SELECT userId FROM spl o WHERE o.split <> spl.split)) AS shared FROM spl GROUP BY split",
        *BF_CTES,
        MD5_SPLIT_SQL,
    ),
)
def q_split_sizes(spark, d):
    """M-7: sizes of the splits, and users found in more than one."""
    name = F.element_at(F.array(F.lit("train"), F.lit("test"), F.lit("validation")), F.col("split") + 1)
    t = md5_split(batch_features(spark, d)).select("userId", name.alias("split"))
    user = t.groupBy("userId", "split").agg(F.count(F.lit(1)).alias("n"))
    user = user.withColumn("splits", F.count(F.lit(1)).over(Window.partitionBy("userId")))
    return user.groupBy("split").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_users"), F.sum(F.when(F.col("splits") > 1, F.col("n")).otherwise(0)).alias("shared")
    )


class _RuleModel:
    """A prediction rule with the interface of a fitted model."""

    def transform(self, bf: DataFrame) -> DataFrame:
        return bf.withColumn("label", F.col("churn").cast("double")).withColumn(
            "prediction", F.when(F.col("last_level") == "free", 1.0).otherwise(0.0)
        )


@register(
    "split_metrics",
    sql(
        "SELECT split, CAST(sum(n) AS BIGINT) AS n, round(sum(tp) / sum(n), 9) AS accuracy, "
        "round(sum(prec * n) / sum(n), 9) AS weighted_precision, round(sum(rec * n) / sum(n), 9) AS weighted_recall, "
        "round(sum(f1 * n) / sum(n), 9) AS weighted_f1 FROM m2 GROUP BY split",
        *BF_CTES,
        MD5_SPLIT_SQL,
        "conf AS (SELECT split, CAST(churn AS DOUBLE) AS l, CASE WHEN last_level = 'free' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS p, "
        "CAST(count(*) AS DOUBLE) AS w FROM spl GROUP BY 1, 2, 3), "
        "pl AS (SELECT split, l, sum(w) AS n, sum(CASE WHEN l = p THEN w ELSE 0 END) AS tp FROM conf GROUP BY split, l), "
        "pp AS (SELECT split, p AS l, sum(CASE WHEN l <> p THEN w ELSE 0 END) AS fp FROM conf GROUP BY split, p), "
        "m AS (SELECT pl.split, pl.l, n, tp, coalesce(fp, 0) AS fp, CASE WHEN tp + coalesce(fp, 0) = 0 THEN 0 "
        "ELSE tp / (tp + coalesce(fp, 0)) END AS prec, tp / n AS rec FROM pl LEFT JOIN pp ON pl.split = pp.split AND pl.l = pp.l), "
        "m2 AS (SELECT *, CASE WHEN prec + rec = 0 THEN 0 ELSE 2 * prec * rec / (prec + rec) END AS f1 FROM m)",
    ),
)
def q_split_metrics(spark, d):
    """M-14: metrics of a fixed prediction rule in every split."""
    m = ML.evaluate_splits(_RuleModel(), md5_split(batch_features(spark, d)))
    return rounded(m, ["accuracy", "weighted_precision", "weighted_recall", "weighted_f1"], 9)


# ---------------------------------------------------------------- ML fits (rows-only checks)


@register("hash_split")
def q_hash_split(spark, d):
    bf = batch_features(spark, d)
    return bf.select("userId", ML.hash_split_column([0.6, 0.2, 0.2], 42).alias("split"))


def notebook_split(spark, d) -> tuple[DataFrame, DataFrame]:
    """Scaled (label, features) table, split 80/20 by user hash.  The training
    table reads the per-user table that ``training_set`` wrote once, so CV
    folds and grid points do not go back to the events."""
    t = ML.scaled_training_set(FE.training_set(raw(spark, d)), keep_key=True)
    train, valid = ML.hash_split(t, [0.8, 0.2], 0)
    return train, valid


def _model_query(name: str):
    def run(spark, d):
        train, valid = notebook_split(spark, d)
        store = ML.fit_store(train, [name])
        return store.fit(ML.best_of_spec(store, name)[0]).transform(valid).select("userId", "label", "prediction")

    return run


for _key, _spec in [("model_forest", "random_forest"), ("model_gbt", "gbt"), ("model_logistic", "logistic_regression"), ("model_svm", "linear_svm")]:
    register(_key)(_model_query(_spec))


def _grid_query(spec: str, model: str):
    def run(spark, d):
        train, _ = notebook_split(spark, d)
        make, folds, grid = ML.MODEL_SPECS[spec]
        return ML.cv_metrics(spark, ML.fit_store(train, [spec]), model, make(), folds, grid)

    return run


for _key, _spec, _model in [
    ("cross_validation", "random_forest", "random_forest"),
    ("grid_search", "linear_svm_tuned", "linear_svm"),
    ("grid_search_forest", "random_forest_tuned", "random_forest"),
]:
    register(_key)(_grid_query(_spec, _model))


@register("model_comparison")
def q_model_comparison(spark, d):
    train, valid = notebook_split(spark, d)
    return ML.compare_models(train, valid)


def _built_model(spark, d):
    """C-7 on the batch features: the fitted pipeline is saved to a fresh folder
    under the shared one (S-5) and loaded back (S-6) as the scoring service would."""
    from ..session import scratch_path
    from ..sources.schema import load_model

    bf = written_batch_features(spark, d)
    dst = scratch_path(spark, f"churn_model/{uuid.uuid4().hex}")
    _, report = ML.build_churn_model(bf, seed=42, dst=dst)
    return load_model(dst), report, bf


@register("build_model")
def q_build_model(spark, d):
    return _built_model(spark, d)[1]


def scoring_requests(bf: DataFrame) -> DataFrame:
    """Every user as a request, plus the same requests with a level the model
    never saw (those must come back as -1)."""
    req = SC.requests_from_features(bf, AS_OF)
    unseen = req.withColumn("request_id", F.xxhash64("request_id", F.lit("unseen"))).withColumn("level", F.lit("unseen"))
    return req.unionByName(unseen)


@register("score_batch")
def q_score_batch(spark, d):
    model, _, bf = _built_model(spark, d)
    return SC.score_requests(model, scoring_requests(bf), AS_OF)


REQUEST_NUMBERS = ("avgEvents", "avgSongs", "thumbsup", "thumbsdown", "add_friend")


def odd_requests(spark: SparkSession, d: str) -> DataFrame:
    """One request for each order, its fields missing, malformed or fine by its key."""
    k = F.col("o_orderkey")
    number = lambda shift: F.when((k + shift) % 11 == 0, F.lit(None)).when((k + shift) % 13 == 0, F.lit("many")).when((k + shift) % 3 == 0, F.lit("2.0")).otherwise(F.lit("3"))
    return fixtures.table(spark, d, "orders").select(
        k.alias("request_id"),
        F.when(k % 2 == 0, F.lit("male")).when(k % 5 == 0, F.lit(None)).otherwise(F.lit("female")).alias("gender"),
        *[number(i).cast("string").alias(c) for i, c in enumerate(REQUEST_NUMBERS)],
        F.when(k % 17 == 0, F.lit("soon")).otherwise(F.lit("2024-08-19")).alias("reg_date"),
        F.when(k % 7 == 0, F.lit("gold")).when(k % 4 == 0, F.lit("paid")).otherwise(F.lit("free")).alias("level"),
        F.lit("CA").alias("location"),
    )


_NUMBER_SQL = (
    "CASE WHEN (k + {i}) % 11 = 0 THEN 0.0 WHEN (k + {i}) % 13 = 0 THEN NULL WHEN (k + {i}) % 3 = 0 THEN 2.0 ELSE 3.0 END"
)


@register(
    "score_unscorable",
    "SELECT k AS request_id, CASE WHEN k % 2 = 0 THEN 'M' ELSE 'F' END AS gender, "
    + ", ".join(
        f"CAST({_NUMBER_SQL.format(i=i)} AS {t}) AS {c}"
        for i, (c, t) in enumerate([("avg_events", "DOUBLE"), ("avg_songs", "DOUBLE"), ("thumbs_up", "INTEGER"), ("thumbs_down", "INTEGER"), ("addfriend", "INTEGER")])
    )
    + ", CASE WHEN k % 17 = 0 THEN NULL ELSE 135 END AS days_active, "
    + "NOT (k % 17 = 0 OR k % 7 = 0"
    + "".join(f" OR ((k + {i}) % 11 <> 0 AND (k + {i}) % 13 = 0)" for i in range(5))
    + ") AS scorable FROM (SELECT o_orderkey AS k FROM orders)",
)
def q_score_unscorable(spark, d):
    """C-8, F-14: request fields as the model sees them, and which rows can be
    scored by indexers that know both genders, two levels and one place."""
    from ..sources.schema import requests_df

    known = requests_df(spark, [(i, g, "1", "1", "1", "1", "1", "2024-01-01", lv, "CA") for i, (g, lv) in enumerate([("male", "free"), ("female", "paid")])])
    model = ML.Pipeline(stages=[ML.category_indexer()]).fit(SC.request_features(known, AS_OF))
    feats = SC.request_features(odd_requests(spark, d), AS_OF)
    flagged = SC.with_scorable(model, feats, ["days_active", *SC.NUMERIC_REQUEST_COLUMNS]).select("request_id", F.col("_ok").alias("scorable"))
    return feats.drop("last_level", "last_state").join(flagged, "request_id")


@register("score_stream")
def q_score_stream(spark, d):
    from ..session import scratch_path
    from ..streaming.scoring import start_scoring

    model, _, bf = _built_model(spark, d)
    # a fresh folder per run: the stream's sink and checkpoint start empty
    base = scratch_path(spark, f"score_stream/{zlib.crc32(d.encode())}/{uuid.uuid4().hex}")
    source, sink, ckpt = f"{base}/requests", f"{base}/scored", f"{base}/checkpoint"
    scoring_requests(bf).write.mode("overwrite").parquet(source)
    q = start_scoring(model, spark, source, sink, ckpt, AS_OF, available_now=True)
    q.awaitTermination()
    return spark.read.parquet(sink)


@register(
    "stream_equals_batch",
    sql("SELECT 2 * count(*) AS n_requests, 2 * count(*) AS n_streamed, CAST(0 AS BIGINT) AS n_different FROM bf", *BF_CTES),
)
def q_stream_equals_batch(spark, d):
    """C-8 / C-9: requests scored by the stream, file by file, against the batch plan of one model."""
    from ..session import scratch_path
    from ..streaming.scoring import start_scoring

    model, _, bf = _built_model(spark, d)
    base = scratch_path(spark, f"stream_equals_batch/{uuid.uuid4().hex}")
    requests = scoring_requests(bf)
    requests.repartition(4, "request_id").write.parquet(f"{base}/requests")
    start_scoring(model, spark, f"{base}/requests", f"{base}/scored", f"{base}/checkpoint", AS_OF, available_now=True, max_files=1).awaitTermination()
    streamed = spark.read.parquet(f"{base}/scored").withColumnRenamed("outcome", "streamed")
    both = SC.score_requests(model, requests, AS_OF).join(streamed, "request_id", "full")
    return both.agg(
        F.count("outcome").alias("n_requests"),
        F.count("streamed").alias("n_streamed"),
        F.count_if(~F.col("outcome").eqNullSafe(F.col("streamed"))).alias("n_different"),
    )


# ---------------------------------------------------------------- SQL over a registered view, filters


@register(
    "sql_users_by_level",
    sql("SELECT level, count(DISTINCT userId) AS count_users FROM clean GROUP BY level", *CLEAN_CTES),
)
def q_sql_users_by_level(spark, d):
    """S-4 + the SQL API: the notebook's query text over a registered view."""
    from ..sources.schema import register as register_view

    register_view(clean(spark, d), "activity")
    return spark.sql(
        "SELECT level, count(DISTINCT userId) AS count_users FROM activity GROUP BY level ORDER BY count_users DESC, level"
    )


@register("sql_length_values", sql("SELECT length FROM clean", *CLEAN_CTES))
def q_sql_length_values(spark, d):
    """P-13: plain projection through SQL (the data behind the length plot)."""
    from ..sources.schema import register as register_view

    register_view(clean(spark, d), "activity")
    return spark.sql("SELECT length FROM activity")


@register("plays", sql("SELECT userId, ts, song, artist, length FROM clean WHERE page = 'NextSong'", *CLEAN_CTES))
def q_plays(spark, d):
    """P-3: events of one page."""
    return CL.events_on(clean(spark, d), X.PLAY_PAGE).select("userId", "ts", "song", "artist", "length")


@register(
    "churned_events",
    sql("SELECT userId, ts, page FROM clean JOIN labels USING (userId) WHERE churn = 1", *LABEL_CTES),
)
def q_churned_events(spark, d):
    """P-5: rows of churned users."""
    return CH.events_of_churned(clean(spark, d).select("userId", "ts", "page")).select("userId", "ts", "page")


@register("churned_events_filtered", ORACLES["churned_events"])
def q_churned_events_filtered(spark, d):
    """P-5 / J-5 behind a Bloom filter of the churned users."""
    return CH.events_of_churned_filtered(clean(spark, d).select("userId", "ts", "page"))


# ---------------------------------------------------------------- tables kept and merged, joined dictionaries and maps


@register("behaviour_features_incremental", ORACLES["behaviour_features"])
def q_behaviour_features_incremental(spark, d):
    """C-2 from user-day states written in three batches, some of whose events come late."""
    from ..session import scratch_path

    a = raw(spark, d)
    path = scratch_path(spark, f"user_days/{uuid.uuid4().hex}")
    late = F.col("itemInSession") < 5
    day = X.day_of("ts")
    arrived = F.when((day <= 10) & ~late, 0).when((day <= 20) & ~late | (day <= 10), 1).otherwise(2)
    for batch in range(3):
        write_states(a.filter(arrived == batch), path, f"b{batch}")
    return behaviour_of_states(spark, path, AS_OF)


@register("label_codes_table", ORACLES["label_encoding"])
def q_label_codes_table(spark, d):
    """M-6 as a written table, codes by range of values."""
    codes = build_codes(FE.category_columns(clean(spark, d)), FE.CATEGORICAL_FEATURES)
    return codes.select("column", "value", F.col("code").cast("int").alias("code"))


@register("categorical_features_joined", ORACLES["categorical_features"])
def q_categorical_features_joined(spark, d):
    """C-3 with the joined dictionary."""
    return FE.categorical_features_joined(raw(spark, d))


@register("indexed_categories_joined", ORACLES["indexed_categories"])
def q_indexed_categories_joined(spark, d):
    """M-1 by falling frequency with a joined dictionary."""
    users = written_batch_features(spark, d)
    names = dict(zip(ML.BATCH_CATEGORICAL, ML.BATCH_INDEXED))
    coded = encode(users, build_codes(users, list(names), "frequency"), names)
    return coded.select("userId", *[F.col(c).cast("double").alias(c) for c in ML.BATCH_INDEXED])


@register(
    "song_codes",
    sql(
        "SELECT c.userId, c.ts, c.song, s.code AS song_code FROM clean c LEFT JOIN s ON c.song = s.song WHERE c.page = 'NextSong'",
        CLEAN,
        "s AS (SELECT song, row_number() OVER (ORDER BY count(*) DESC, song) - 1 AS code FROM clean "
        "WHERE page = 'NextSong' AND song IS NOT NULL GROUP BY song)",
    ),
)
def q_song_codes(spark, d):
    """M-1 on every play: songs coded by falling frequency, hot songs salted."""
    plays = CL.events_on(clean(spark, d), X.PLAY_PAGE).select("userId", "ts", "song")
    return encode(plays, build_codes(plays, ["song"], "frequency"), {"song": "song_code"}, salts=4)


@register(
    "mapped_customers",
    sql("SELECT c.ts, c.page, coalesce(m.c_name, c.userId) AS userId FROM clean c LEFT JOIN customer m ON c.userId = CAST(m.c_custkey AS VARCHAR)", *CLEAN_CTES),
)
def q_mapped_customers(spark, d):
    """P-11 with a mapping that grows with the data: user ids to customer names."""
    names = fixtures.table(spark, d, "customer")
    return CL.map_values_from(clean(spark, d).select("ts", "page", "userId"), "userId", names, "c_custkey", "c_name")


def _beside_exact(estimates: DataFrame, exact: DataFrame, dims: list[str]) -> DataFrame:
    """Exact counts and whether the estimate lies within five standard errors (or one user)."""
    both = exact.join(estimates.withColumnRenamed("count_users", "_estimate"), dims)
    bound = F.greatest(F.lit(1.0), 5 * relative_error() * F.col("count_users"))
    return both.select(*dims, "count_users", (F.abs(F.col("_estimate") - F.col("count_users")) <= bound).alias("within_bound"))


@register(
    "monthly_users_sketched",
    sql(
        "SELECT level, strftime(t, '%Y-%m') AS month, count(DISTINCT userId) AS count_users, TRUE AS within_bound FROM clean GROUP BY 1, 2",
        *CLEAN_CTES,
    ),
)
def q_monthly_users_sketched(spark, d):
    """A-3 / A-4: daily sketches written once and merged into months, beside the exact counts."""
    a = clean(spark, d)
    month = F.substring(X.day_date("day").cast("string"), 1, 7).alias("month")
    daily = materialize(user_sketches(a, ["level", X.event_day("ts").alias("day")]), "user_sketches")
    months = estimated_users(merge_sketches(daily, ["level", month]))
    exact = a.withColumn("day", X.event_day("ts")).groupBy("level", month).agg(F.count_distinct("userId").alias("count_users"))
    return _beside_exact(months, exact, ["level", "month"])


@register(
    "state_users_sketched",
    sql(
        f"SELECT {STATE_SQL.format(x='location')} AS state, count(DISTINCT userId) AS count_users, TRUE AS within_bound FROM clean "
        f"WHERE {STATE_SQL.format(x='location')} IS NOT NULL GROUP BY 1",
        *CLEAN_CTES,
    ),
)
def q_state_users_sketched(spark, d):
    """A-6 by merged sketches: users of each state group counted once, beside the exact counts."""
    a = clean(spark, d)
    places = materialize(user_sketches(a, ["location"]), "user_sketches")
    state = X.state_group("location").alias("state")
    states = estimated_users(merge_sketches(places.filter(state.isNotNull()), [state]))
    exact = a.filter(state.isNotNull()).groupBy(state).agg(F.count_distinct("userId").alias("count_users"))
    return _beside_exact(states, exact, ["state"])


# ---------------------------------------------------------------- the report as one table


def _report_sql() -> str:
    """The long table from the statements of the single queries."""
    one = lambda q, table, key, value: f"SELECT '{table}' AS \"table\", {key} AS key, CAST({value} AS DOUBLE) AS value FROM ({ORACLES[q]})"
    text = lambda c: f"coalesce(CAST({c} AS VARCHAR), '-')"
    parts = [one(f"users_by_{c.lower() if c == 'userAgent' else c}", f"users_by_{c}", text(f'"{c}"'), "count_users") for c in ["auth", "gender", "level", "location"]]
    parts.append("SELECT 'users_by_userAgent', userAgent, CAST(n AS DOUBLE) FROM (" + sql("SELECT userAgent, count(DISTINCT userId) AS n FROM clean GROUP BY userAgent", *CLEAN_CTES) + ")")
    parts.append(one("events_by_page", "events_by_page", "page", "count_users"))
    for c in ["hour", "day", "weekday"]:
        parts.append(f"SELECT 'events_by_{c}', CAST({c} AS VARCHAR), CAST(n AS DOUBLE) FROM (" + sql(f"SELECT {c}, count(*) AS n FROM clean GROUP BY {c}", *CLEAN_CTES) + ")")
    parts += [one(f"{c}_rollup", f"{c}_rollup", c, "count_users") for c in ["state", "browser", "platform"]]
    parts += [one(f"events_by_churn_{c}", f"events_by_churn_{c}", f"concat(churn, '|', {text(c)})", "count") for c in EVENT_DIMS]
    parts += [one(f"churn_by_{c}", f"churn_by_{c}", f"concat(churn, '|', {text(c)})", "count") for c in USER_DIMS]
    parts += [one(f"ztest_{c}", f"ztest_{c}", f"'{v}'", v) for c in ["gender", "level"] for v in ["z", "p_value"]]
    parts += [one("length_by_churn", "length_by_churn", f"concat(churn, '|{c}')", f"round({c}, 6)") for c in ["mean_length", "stddev_length", "minimum_length", "maximum_length"]]
    parts.append("SELECT 'row_count', 'events', CAST(n AS DOUBLE) FROM (" + sql("SELECT count(*) AS n FROM clean", *CLEAN_CTES) + ")")
    parts += [
        one("distinct_users", "distinct_users", "'users'", "unique_users"),
        one("level_changers", "level_changers", "'users'", "n_users"),
        one("churn_counts", "churn_counts", "CAST(churn AS VARCHAR)", "n_users"),
        one("length_histogram", "length_histogram", "CAST(bin AS VARCHAR)", "n"),
    ]
    return " UNION ALL ".join(parts)


@register("report", _report_sql())
def q_report(spark, d):
    """C-10: the exploration report from shared aggregates."""
    from .report import report_table

    return report_table(raw(spark, d))
