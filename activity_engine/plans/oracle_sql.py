"""Independent SQL for each registered query (ANSI-ish, run by DuckDB).

Every statement starts from the same activity view, built from the test
tables by the rules of FIXTURES.md section 2, written here in SQL with no
shared code with the Spark side.  Statements are written the way the
reference computes (daily averages, self-joins, dictionaries) wherever that
differs from the Spark plan, so that agreement means something.
"""

from __future__ import annotations

AS_OF = "2025-01-01"

ACTIVITY = """
activity AS (
  SELECT
    CASE WHEN e.k = 99 THEN '' ELSE CAST(e.user_id AS VARCHAR) END AS userId,
    CAST(e.user_id * 100 + day(e.ts) AS BIGINT) AS sessionId,
    CAST(e.event_id % 50 AS BIGINT) AS itemInSession,
    CAST(epoch_us(e.ts - CASE WHEN e.user_id % 23 = 0 AND hour(e.ts) > 12 THEN INTERVAL 12 HOUR ELSE INTERVAL 0 HOUR END
         + CASE WHEN e.user_id % 29 = 0 AND day(e.ts) <= 15 THEN INTERVAL 15 DAY ELSE INTERVAL 0 DAY END) // 1000 AS BIGINT) AS ts,
    e.page,
    CASE WHEN e.page = 'Cancellation Confirmation' THEN 'Cancelled' ELSE 'Logged In' END AS auth,
    CASE WHEN e.k < 50 THEN 'free' ELSE 'paid' END AS level,
    CASE WHEN e.user_id % 17 = 0 AND e.k % 2 = 0 THEN NULL WHEN e.user_id % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
    CASE WHEN e.user_id % 19 = 0 AND e.k >= 50 THEN NULL ELSE n.n_name || ', ' || CASE WHEN n.n_nationkey % 3 = 0 THEN 'ZZ-' ELSE '' END || substr(r.r_name, 1, 2) END AS location,
    CASE WHEN e.user_id % 11 = 0 THEN 'curl/7.64.1' ELSE CASE (e.user_id + e.k) % 5
      WHEN 0 THEN 'Mozilla/5.0 (Windows NT 6.1; WOW64; rv:31.0) Gecko/20100101 Firefox/31.0'
      WHEN 1 THEN 'Mozilla/5.0 (Macintosh; Intel Mac OS X 10_9_4) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/36.0 Safari/537.36'
      WHEN 2 THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 7_1_2 like Mac OS X) AppleWebKit/537.51 (KHTML, like Gecko) Version/7.0 Safari/9537.53'
      WHEN 3 THEN 'Mozilla/5.0 (compatible; MSIE 9.0; Windows NT 6.1; Trident/5.0)'
      ELSE 'Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/36.0 Safari/537.36'
    END END AS userAgent,
    CASE WHEN e.page = 'NextSong' AND e.event_id % 97 <> 0 THEN concat('song_', CAST(e.event_id % 200 AS VARCHAR)) END AS song,
    CASE WHEN e.page = 'NextSong' THEN concat('artist_', CAST(e.event_id % 60 AS VARCHAR)) END AS artist,
    CASE WHEN e.page = 'NextSong' THEN e.value END AS length
  FROM (
    SELECT ev.*,
      CASE
        WHEN ev.event_type = 'error' THEN CASE WHEN ev.k IN (95, 96) THEN 'Cancellation Confirmation'
                                            WHEN ev.k < 10 THEN 'Thumbs Down' ELSE 'Roll Advert' END
        WHEN ev.event_type = 'click' THEN CASE WHEN ev.user_id % 13 = 0 THEN 'Home' ELSE 'NextSong' END
        WHEN ev.event_type = 'view' THEN CASE WHEN ev.k < 40 THEN 'Thumbs Up' WHEN ev.k < 70 THEN 'Add to Playlist' ELSE 'Logout' END
        WHEN ev.event_type = 'signup' THEN CASE WHEN ev.k < 20 THEN 'Add Friend' WHEN ev.k < 60 THEN 'Help' ELSE 'Home' END
        WHEN ev.event_type = 'purchase' THEN CASE WHEN ev.k < 50 THEN 'Downgrade' ELSE 'Settings' END
      END AS page
    FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events) ev
  ) e
  JOIN customer c ON e.user_id = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

# The feature lists, spelled out here a second time so that a gap in the
# engine's lists shows as a difference.
PAGES = ["NextSong", "Thumbs Up", "Downgrade", "Add to Playlist", "Add Friend", "Roll Advert", "Help", "Logout"]
CATEGORIES = ["gender", "level", "browser", "platform"]
NUMBERS = [
    "average_length", "stddev_length", "max_length", "min_length",
    "NextSong", "Thumbs Up", "Downgrade", "Add to Playlist", "Add Friend", "Roll Advert", "Help", "Logout",
    "sum_pages", "unique_songs", "total_songs", "unique_artists", "month_percentage", "hour_percentage",
]

# Cleaned rows plus the time parts the notebook derives (UTC).
CLEAN = """
clean AS (
  SELECT *,
    make_timestamp(ts * 1000) AS t,
    strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS date,
    CAST(hour(make_timestamp(ts * 1000)) AS INTEGER) AS hour,
    CAST(day(make_timestamp(ts * 1000)) AS INTEGER) AS day,
    CAST(dayofweek(make_timestamp(ts * 1000)) AS INTEGER) AS weekday
  FROM activity WHERE userId <> ''
)"""

# Per user churn label (the reference: users with a cancellation page).
LABELS = """
labels AS (
  SELECT userId, MAX(CASE WHEN page = 'Cancellation Confirmation' THEN 1 ELSE 0 END) AS churn
  FROM clean GROUP BY userId
)"""

# The user's last event (ts, sessionId, itemInSession, then the other columns in a stated order).
LATEST = """
latest AS (
  SELECT * FROM (
    SELECT c.*, ROW_NUMBER() OVER (PARTITION BY userId ORDER BY ts DESC, sessionId DESC, itemInSession DESC,
                                   page DESC NULLS LAST, level DESC NULLS LAST, gender DESC NULLS LAST, location DESC NULLS LAST,
                                   userAgent DESC NULLS LAST, auth DESC NULLS LAST, song DESC NULLS LAST,
                                   artist DESC NULLS LAST, length DESC NULLS LAST) AS rn
    FROM clean c) WHERE rn = 1
)"""

# Derived per-row dimensions as the notebook computes them.
DIMS = """
dims AS (
  SELECT c.*, l.churn,
    split_part(location, ',', 1) AS city,
    CASE WHEN strpos(location, ',') > 0 THEN trim(split_part(location, ',', 2)) END AS state,
    CASE WHEN userAgent LIKE '%Firefox%' THEN 'Firefox'
         WHEN userAgent LIKE '%Safari%' AND userAgent LIKE '%Chrome%' THEN 'Chrome'
         WHEN userAgent LIKE '%Safari%' THEN 'Safari'
         WHEN userAgent LIKE '%Trident%' THEN 'IE' END AS browser,
    CASE split_part(regexp_extract(userAgent, '\\(([^\\)]*)\\)', 1), ';', 1)
         WHEN 'compatible' THEN 'Windows' WHEN 'iPad' THEN 'iPad' WHEN 'iPhone' THEN 'iPhone'
         WHEN 'Macintosh' THEN 'Mac' WHEN 'Windows NT 5.1' THEN 'Windows' WHEN 'Windows NT 6.0' THEN 'Windows'
         WHEN 'Windows NT 6.1' THEN 'Windows' WHEN 'Windows NT 6.2' THEN 'Windows' WHEN 'Windows NT 6.3' THEN 'Windows'
         WHEN 'X11' THEN 'Linux' END AS platform
  FROM clean c JOIN labels l USING (userId)
)"""


def with_ctes(*parts: str, body: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + body
