"""Activity view over the driver's test tables (FIXTURES.md section 2).

The test data has no music-service event log, so the engine's input is
derived from ``events`` joined to ``customer``, ``nation`` and ``region``.
The rules live here once; the DuckDB oracle builds the same view from the
same rules (``plans/oracle_sql.py``).

Plan shape: ``nation`` and ``region`` are fixed-size dimensions (25 and 5
rows by the TPC-H spec) and are broadcast explicitly, each joined straight
to the event side so their broadcasts are independent stages rather than a
chain.  ``customer`` grows with the scale factor, so it is joined without a
hint: AQE turns the join into a broadcast at run time only when the
measured size allows it and otherwise keeps a sort-merge join with skew
splitting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# User agent strings of the activity view, by index 0..4.
USER_AGENTS = [
    "Mozilla/5.0 (Windows NT 6.1; WOW64; rv:31.0) Gecko/20100101 Firefox/31.0",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_9_4) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/36.0 Safari/537.36",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 7_1_2 like Mac OS X) AppleWebKit/537.51 (KHTML, like Gecko) Version/7.0 Safari/9537.53",
    "Mozilla/5.0 (compatible; MSIE 9.0; Windows NT 6.1; Trident/5.0)",
    "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/36.0 Safari/537.36",
]
UNKNOWN_AGENT = "curl/7.64.1"


# Columns of the test tables that the view reads.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table as a DataFrame, read with its declared schema (no job to infer one)."""
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def _page(event_type: Column, k: Column) -> Column:
    return (
        F.when(event_type == "error", F.when(k.isin(95, 96), "Cancellation Confirmation").when(k < 10, "Thumbs Down").otherwise("Roll Advert"))
        .when(event_type == "click", F.lit("NextSong"))
        .when(event_type == "view", F.when(k < 40, "Thumbs Up").when(k < 70, "Add to Playlist").otherwise("Logout"))
        .when(event_type == "signup", F.when(k < 20, "Add Friend").when(k < 60, "Help").otherwise("Home"))
        .when(event_type == "purchase", F.when(k < 50, "Downgrade").otherwise("Settings"))
    )


def _epoch_millis(name: str) -> Column:
    """Milliseconds since 1970 of a timestamp without a zone, its fields read as UTC."""
    t = F.col(name).cast("timestamp_ntz")
    second = F.floor(F.extract(F.lit("SECOND"), t) * 1000).cast("long")
    return (F.unix_date(t.cast("date")).cast("long") * 24 + F.hour(t)) * 3_600_000 + F.minute(t) * 60_000 + second


def _location() -> Column:
    """``NATION_n, [ZZ-]RE``: nation name, then the first two letters of the region."""
    return F.concat(
        F.col("n_name"),
        F.lit(", "),
        F.when(F.col("n_nationkey") % 3 == 0, F.lit("ZZ-")).otherwise(F.lit("")),
        F.substring("r_name", 1, 2),
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw activity log (blank users included), columns as ACTIVITY_COLUMNS."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    ev = ev.withColumn("k", F.regexp_extract("props", r"([0-9]+)", 1).try_cast("int"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    joined = (
        ev.join(customer, ev.user_id == customer.c_custkey)
        .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    user, hour, day = F.col("user_id"), F.hour("ts"), F.dayofmonth("ts")
    # some users without late or early events (T-4, their times move to the other half of the
    # day or month), plays (T-3), gender, place or a known agent (T-2)
    moved = F.when((user % 23 == 0) & (hour > 12), -12 * 3_600_000).otherwise(0) + F.when((user % 29 == 0) & (day <= 15), 15 * 86_400_000).otherwise(0)
    silent = user % 13 == 0
    page = F.when((F.col("event_type") == "click") & silent, F.lit("Home")).otherwise(_page(F.col("event_type"), F.col("k")))
    play = (F.col("event_type") == "click") & ~silent
    agents = F.array(*[F.lit(a) for a in USER_AGENTS])
    return joined.select(
        F.when(F.col("k") == 99, F.lit("")).otherwise(user.cast("string")).alias("userId"),
        (user * 100 + day).cast("long").alias("sessionId"),
        (F.col("event_id") % 50).alias("itemInSession"),
        # a timestamp without a zone is read as UTC, whatever the session zone
        (_epoch_millis("ts") + moved).alias("ts"),
        page.alias("page"),
        F.when(page == "Cancellation Confirmation", "Cancelled").otherwise("Logged In").alias("auth"),
        F.when(F.col("k") < 50, "free").otherwise("paid").alias("level"),
        F.when((user % 17 == 0) & (F.col("k") % 2 == 0), F.lit(None)).when(user % 2 == 0, "F").otherwise("M").alias("gender"),
        F.when((user % 19 == 0) & (F.col("k") >= 50), F.lit(None)).otherwise(_location()).alias("location"),
        F.when(user % 11 == 0, F.lit(UNKNOWN_AGENT)).otherwise(F.get(agents, ((user + F.col("k")) % 5).cast("int"))).alias("userAgent"),
        # some plays without a song (T-9)
        F.when(play & (F.col("event_id") % 97 != 0), F.concat(F.lit("song_"), (F.col("event_id") % 200).cast("string"))).alias("song"),
        F.when(play, F.concat(F.lit("artist_"), (F.col("event_id") % 60).cast("string"))).alias("artist"),
        F.when(play, F.col("value")).alias("length"),
    )
