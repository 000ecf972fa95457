"""Session settings the engine relies on.

Every time function in the engine works in UTC (the batch job of the
reference does, its notebook used the machine zone; we pin UTC), so the
session zone is set before any plan is built.  Nothing else is forced on a
session the caller hands us: the cluster's own sizing wins.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

UTC = "UTC"


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session zone to UTC and keep AQE on (idempotent)."""
    conf = spark.conf
    if conf.get("spark.sql.session.timeZone", None) != UTC:
        conf.set("spark.sql.session.timeZone", UTC)
    if conf.get("spark.sql.adaptive.enabled", "true") != "true":
        conf.set("spark.sql.adaptive.enabled", "true")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediate tables.

    Read from ``spark.checkpoint.dir`` (the cluster names a shared folder
    there).  Where it is unset, a scratch folder is made, but only when the
    master is local (tests, bench): on a cluster a machine-local folder would
    lose rows on the read back, so an unset key raises there.
    """
    ctx = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        if not ctx.getCheckpointDir():
            ctx.setCheckpointDir(path)
        return path
    if ctx.getCheckpointDir():
        return ctx.getCheckpointDir()
    require_local(ctx.master)
    path = tempfile.mkdtemp(prefix="activity-engine-ckpt-")
    ctx.setCheckpointDir(path)
    return ctx.getCheckpointDir() or path


def require_local(master: str) -> None:
    """Raise unless ``master`` runs driver and executors in one process."""
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir is not set; on {master} it must name a folder that all executors share")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for a written table."""
    base = checkpoint_dir(spark)
    if "://" in base:
        return base.rstrip("/") + "/" + name
    return os.path.join(base, name)


def local_session(cores: int = 8, app: str = "activity-engine", **extra: str) -> SparkSession:
    """Session for tests and the bench: local mode, UI off, UTC, AQE."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.default.parallelism", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", UTC)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


_WRITTEN: dict[str, list[str]] = {}


def materialize(df: DataFrame, name: str = "table", unique: bool = True) -> DataFrame:
    """Write ``df`` once as parquet under the shared checkpoint folder and read
    it back: the plan runs once, later readers see a table with no lineage
    behind it (a lost executor costs a re-read).  ``unique`` gives every call
    its own folder, so a lazily read result is never overwritten by a later
    call.  ``drop_intermediates`` deletes these tables once their readers are
    done."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}/{uuid.uuid4().hex}" if unique else name)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_intermediates(spark: SparkSession) -> int:
    """Delete what ``materialize`` wrote in this application so far; frames that
    still read those tables must have been used.  Returns how many went."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        delete_path(spark, path)
    return len(paths)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a written folder through the file system that holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Written intermediate tables of one operator call.

    ``table`` writes a frame once under the shared folder and reads it back;
    leaving the ``with`` block deletes every table but those of ``keep``
    (what the returned frame still reads), and destroys the broadcasts given to
    ``own`` (their files stay in the local folders else).
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = scratch_path(spark, f"{name}/{uuid.uuid4().hex}")
        self._written: dict[str, str] = {}
        self._kept: set[str] = set()
        self._broadcasts: list[Broadcast] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for name, path in self._written.items():
            if name not in self._kept:
                delete_path(self.spark, path)
        for value in self._broadcasts:
            value.destroy()

    def own(self, value: Broadcast) -> Broadcast:
        """A broadcast that goes when the block is left; frames that use it must
        have been written by then."""
        self._broadcasts.append(value)
        return value

    def path(self, name: str) -> str:
        """A folder of this call, deleted with its tables."""
        self._written[name] = f"{self.root}/{name}"
        return self._written[name]

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self._written[name])

    def drop(self, name: str) -> None:
        """Delete one table early."""
        delete_path(self.spark, self._written.pop(name))

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write the frame that the operator returns; it outlives the block."""
        out = self.table(df, name)
        self._kept.add(name)
        return out
