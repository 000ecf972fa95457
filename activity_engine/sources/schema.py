"""Schemas, readers and writers (S-1 .. S-9).

The event log is read with a declared schema: no inference pass over the
input, and the column order of the feature tables is fixed by the lists
below rather than by whatever order a JSON reader infers.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("artist", T.StringType()),
        T.StructField("auth", T.StringType()),
        T.StructField("firstName", T.StringType()),
        T.StructField("gender", T.StringType()),
        T.StructField("itemInSession", T.LongType()),
        T.StructField("lastName", T.StringType()),
        T.StructField("length", T.DoubleType()),
        T.StructField("level", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("page", T.StringType()),
        T.StructField("sessionId", T.LongType()),
        T.StructField("song", T.StringType()),
        T.StructField("status", T.LongType()),
        T.StructField("ts", T.LongType()),
        T.StructField("userAgent", T.StringType()),
        T.StructField("userId", T.StringType()),
    ]
)

# Columns the engine reads from an event log, in the order of the activity view.
ACTIVITY_COLUMNS = [
    "userId",
    "sessionId",
    "itemInSession",
    "ts",
    "page",
    "auth",
    "level",
    "gender",
    "location",
    "userAgent",
    "song",
    "artist",
    "length",
]

# Batch feature table (C-2), in output order.
BEHAVIOUR_SCHEMA = T.StructType(
    [
        T.StructField("userId", T.StringType()),
        T.StructField("gender", T.StringType()),
        T.StructField("churn", T.IntegerType()),
        T.StructField("last_level", T.StringType()),
        T.StructField("days_active", T.IntegerType()),
        T.StructField("last_state", T.StringType()),
        T.StructField("avg_songs", T.DoubleType()),
        T.StructField("avg_events", T.DoubleType()),
        T.StructField("thumbs_up", T.LongType()),
        T.StructField("thumbs_down", T.LongType()),
        T.StructField("addfriend", T.LongType()),
    ]
)

# Notebook feature table (C-5): key, 4 categorical codes, 18 numbers, label.
CATEGORICAL_FEATURES = ["gender", "level", "browser", "platform"]
# The pages counted per user, in feature order.
PIVOT_PAGES = [
    "NextSong",
    "Thumbs Up",
    "Downgrade",
    "Add to Playlist",
    "Add Friend",
    "Roll Advert",
    "Help",
    "Logout",
]
NUMERICAL_FEATURES = (
    ["average_length", "stddev_length", "max_length", "min_length"]
    + PIVOT_PAGES
    + ["sum_pages", "unique_songs", "total_songs", "unique_artists", "month_percentage", "hour_percentage"]
)
TRAINING_SCHEMA = T.StructType(
    [T.StructField("userId", T.StringType())]
    + [T.StructField(c, T.IntegerType()) for c in CATEGORICAL_FEATURES]
    + [T.StructField(c, T.FloatType()) for c in NUMERICAL_FEATURES]
    + [T.StructField("Churn", T.IntegerType())]
)

# Scoring request (C-8): one row per request, raw form fields.
REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("gender", T.StringType()),
        T.StructField("avgEvents", T.StringType()),
        T.StructField("avgSongs", T.StringType()),
        T.StructField("thumbsup", T.StringType()),
        T.StructField("thumbsdown", T.StringType()),
        T.StructField("add_friend", T.StringType()),
        T.StructField("reg_date", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("location", T.StringType()),
    ]
)


def read_events(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """S-1: read an event log (JSON lines or parquet) with the declared schema."""
    return spark.read.schema(EVENT_SCHEMA).format(fmt).load(path)


def parse_lines(lines: DataFrame) -> DataFrame:
    """S-1: text lines (column ``value``) as events of the declared schema beside
    ``value`` and ``malformed``, true where a line is no JSON object of that
    schema (a field of another type included).  Lines without content are left out."""
    schema = T.StructType([*EVENT_SCHEMA.fields, T.StructField("_broken", T.StringType())])
    event = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    parsed = lines.filter(F.trim("value") != "").withColumn("event", event)
    return parsed.select("value", (F.col("event").isNull() | F.col("event._broken").isNotNull()).alias("malformed"), *[f"event.{f.name}" for f in EVENT_SCHEMA.fields])


def read_events_checked(spark: SparkSession, path: str, quarantine: str) -> DataFrame:
    """S-1: the events of a JSON-lines log.  Malformed lines are written to the
    folder ``quarantine`` as they stand (column ``value``) and are not events."""
    parsed = parse_lines(spark.read.text(path))
    parsed.filter("malformed").select("value").write.mode("overwrite").parquet(quarantine)
    return parsed.filter("NOT malformed").drop("value", "malformed")


def line_counts(lines: DataFrame) -> DataFrame:
    """P-2 for a raw log, in one pass: lines, malformed lines, events without a user
    (null, blank) and clean ones; the last four add up to the first."""
    user = F.when(~F.col("malformed"), F.col("userId"))
    return parse_lines(lines).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if("malformed").alias("n_malformed"),
        F.count_if(~F.col("malformed") & F.col("userId").isNull()).alias("n_null_user"),
        F.count_if(user == "").alias("n_blank_user"),
        F.count_if(user != "").alias("n_clean"),
    )


def read_features(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = TRAINING_SCHEMA) -> DataFrame:
    """S-2: read a stored feature table back with its declared schema and order."""
    df = spark.read.schema(schema).format(fmt).load(path)
    return df.select(*[F.col(f"`{f.name}`") for f in schema.fields])


def write_features(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """S-3: write a feature table (overwrite by default, as the notebook does)."""
    df.write.mode(mode).format(fmt).save(path)


def register(df: DataFrame, name: str = "activity") -> DataFrame:
    """S-4: expose a DataFrame to ``spark.sql`` under ``name``."""
    df.createOrReplaceTempView(name)
    return df


def save_model(model, path: str, overwrite: bool = False) -> None:
    """S-5: save a fitted model; like the reference, refuse an existing path unless told."""
    writer = model.write()
    if overwrite:
        writer = writer.overwrite()
    writer.save(path)


def load_model(path: str) -> PipelineModel:
    """S-6: load a fitted pipeline."""
    return PipelineModel.load(path)


def requests_df(spark: SparkSession, rows) -> DataFrame:
    """S-7: scoring requests (tuples or dicts in REQUEST_SCHEMA order) as a DataFrame."""
    return spark.createDataFrame(rows, REQUEST_SCHEMA)


def schema_report(df: DataFrame) -> DataFrame:
    """S-9: the schema as a table (position, column, type, nullable)."""
    spark = df.sparkSession
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "position int, column string, type string, nullable boolean")
