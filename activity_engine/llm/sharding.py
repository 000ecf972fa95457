"""Sharding by weighted rendezvous hashing of stable record keys.

Every (key, shard) pair hashes to a number u in (0, 1) and a record goes to
the shard with the largest ``-weight / ln(u)``.  Shards draw records in
proportion to their weights, and a shard's scores do not depend on the other
shards: one more shard takes records only into itself, one less gives only
its own away.  The choice is one JVM expression over the key, no shuffle.

``slot`` numbers a shard's records from 0 without gaps.  Records are written
once with the number of their input partition, records are counted for each
(partition, shard), and the running total of those counts is added to the
place inside the partition; no task handles more than one partition's rows.

Cases: a null key is a key of its own (as the empty string); null texts have
size 1 and crc32 0; equal keys go to one shard and get slots of their own;
an empty table gives no rows; other columns are ignored by ``shard_table``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard (0 to len(weights) - 1) of a key; a weight of 0 draws nothing."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    scores = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            # 52 bits and a half: exact as a double, and never 0 or 1
            u = (F.shiftrightunsigned(F.xxhash64(text, F.lit(shard)), 12).cast("double") + 0.5) / float(1 << 52)
            scores.append(F.struct((F.lit(-float(weight)) / F.ln(u)).alias("score"), F.lit(shard).alias("shard")))
    return F.array_max(F.array(*scores))["shard"]


def shard_table(docs: DataFrame, weights: Sequence[float], added: float | None = None) -> DataFrame:
    """doc_id, size (UTF-8 bytes and one), text_crc32, law, shard, slot, and
    grown_shard, the shard once one more of weight ``added`` joins."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col("doc_id"), weights).alias("shard"),
        (F.lit(None).cast("int") if added is None else rendezvous(F.col("doc_id"), [*weights, added])).alias("grown_shard"),
        F.spark_partition_id().alias("_part"),
    )
    with Scratch(docs.sparkSession, "sharding") as scratch:
        placed = scratch.table(rows, "placed")
        counts = placed.groupBy("_part", "shard").agg(F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        base = counts.select("_part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
        inside = Window.partitionBy("_part", "shard").orderBy("doc_id", "size", "text_crc32")
        out = placed.withColumn("_place", F.row_number().over(inside) - 1).join(base, ["_part", "shard"])
        out = out.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("_base") + F.col("_place")).cast("long").alias("slot"), "grown_shard")
        return scratch.keep(out, "result")


def write_shards(df: DataFrame, path: str, weights: Sequence[float], key: str = "doc_id", shard: str = "shard") -> None:
    """``df`` as Parquet, one folder a shard; each task writes its rows where they
    lie.  The folders are named by ``shard``, which must not be a column of ``df``."""
    if shard.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"the table has a column {shard!r}; name another for the shard")
    df.withColumn(shard, rendezvous(F.col(key), weights)).write.partitionBy(shard).parquet(path)
