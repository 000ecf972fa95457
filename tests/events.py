"""Hand-written event rows for micro-fixtures (FIXTURES.md section 3)."""

from activity_engine.sources.schema import ACTIVITY_COLUMNS

CHROME = "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_9_4) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/36.0 Safari/537.36"
DAY = 86_400_000
T0 = 1538352000000  # 2018-10-01 00:00:00 UTC, a Monday

DEFAULTS = dict(
    userId="u",
    sessionId=1,
    itemInSession=0,
    ts=T0 + 14 * 3_600_000,
    page="NextSong",
    auth="Logged In",
    level="free",
    gender="M",
    location="Boston-Cambridge, MA-NH",
    userAgent=CHROME,
    song="s",
    artist="a",
    length=100.0,
)

SCHEMA = (
    "userId string, sessionId bigint, itemInSession bigint, ts bigint, page string, auth string, level string, "
    "gender string, location string, userAgent string, song string, artist string, length double"
)


def events(spark, *rows):
    full = []
    for r in rows:
        d = dict(DEFAULTS)
        if r.get("page", "NextSong") != "NextSong":
            d.update(song=None, artist=None, length=None)
        d.update(r)
        full.append(tuple(d[c] for c in ACTIVITY_COLUMNS))
    return spark.createDataFrame(full, SCHEMA)
