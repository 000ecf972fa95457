"""Event tables laid out by user, for per-user values on every event (W-1, W-4, W-5, J-5).

A table bucketed and sorted by user is shuffled once, when it is written.  Any
number of later spreads (the user's churn flag, span, counts on each event)
then group and join bucket by bucket: no exchange of events.  ``subs`` above 1
splits every user over so many sub-buckets, so a user with a third of the log
is no single bucket; what a spread then shuffles is the partial aggregate, a
row for each user and task, and the per-user rows, one for each sub-bucket.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

SUB = "_sub"


def write_user_buckets(events: DataFrame, name: str, buckets: int, subs: int = 1) -> DataFrame:
    """Write ``events`` bucketed and sorted by ``userId`` under the shared folder
    and return the table (with the column ``_sub`` when ``subs`` is above 1)."""
    spark = events.sparkSession
    unique = uuid.uuid4().hex
    keys = ["userId"] if subs == 1 else ["userId", SUB]
    rows = events if subs == 1 else events.withColumn(SUB, F.pmod(F.xxhash64(*events.columns), F.lit(subs)).cast("int"))
    # dealt like the buckets: a task writes one file
    dealt = rows.repartition(buckets, *keys)
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", scratch_path(spark, f"{name}/{unique}")).saveAsTable(f"{name}_{unique}")
    return spark.table(f"{name}_{unique}")


def spread(events: DataFrame, per_user: DataFrame, subs: int = 1) -> DataFrame:
    """``events`` of a bucketed table with the columns of ``per_user`` (one row a
    user) on each; users without a row there lose their events."""
    if subs == 1:
        return events.join(per_user, "userId")
    split = per_user.withColumn(SUB, F.explode(F.sequence(F.lit(0), F.lit(subs - 1))))
    return events.join(split, ["userId", SUB]).drop(SUB)
