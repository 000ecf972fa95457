"""Token counts of flat, unindexed token files by scanning for separators.

A flat file is nothing but ids, an end-of-document id after each document.
Files are read in blocks of ``BLOCK`` ids, blocks in parallel; in each, one
vectorised comparison finds the separators.  A document may begin blocks
before the one that ends it, so blocks are stitched by a prefix scan over a
file's blocks: the running number of separators gives a document's ordinal,
the running maximum of their places gives where an open document began.

Cases: an empty file has no documents; two separators in a row are a document
of 0 tokens; ids after the last separator are a document that is not
``closed``; a file whose size is not a multiple of the id width raises.  For
``write_flat``: null or blank texts are documents of 0 tokens; a text cannot
hold the separator (strings of special tokens are ordinary text there); a
null ``doc_id`` is carried, equal ids keep a document each; an empty table
writes no files; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch
from . import files
from .tokens import shards
from .words import slices

SHARD = 1 << 22  # ids of a file, more only where one document is longer
BLOCK = 1 << 18  # ids read and searched at once
WIDTH = 2  # bytes of an id, little-endian
TASK_BLOCKS = 64  # blocks that one task searches, about


def _write(folder: str, path: str, end_id: int, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task that runs again writes files of its own; the rows name those that count
        attempt = TaskContext.get().taskAttemptId()
        for number, (ids, _, docs) in enumerate(shards(batches, path, end_id, limit, False, slices)):
            name = f"{attempt:09d}-{number:06d}.ids"
            if len(ids) and int(ids.max()) >> (8 * WIDTH):
                raise ValueError(f"an id needs more than {WIDTH} bytes")
            files.write(f"{folder}/{name}", ids.astype("<u2").tobytes())
            yield pa.record_batch(
                [pa.array([name] * len(docs)), pa.array(range(len(docs)), pa.int64()), pa.array(docs, pa.int64())], ["file", "ordinal", "doc_id"]
            )

    return run


def write_flat(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shard: int = SHARD) -> DataFrame:
    """Write flat files where the rows lie, no shuffle of texts; a row for each
    document (file, ordinal in the file, doc_id).  Runs when the frame does."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_write(folder, tokenizer, end_id, shard), "file string, ordinal long, doc_id long")


def _sizes(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("file"), pa.array([files.size(f"{folder}/{f}") for f in batch.column("file").to_pylist()], pa.int64())], ["file", "bytes"])

    return run


def _search(folder: str, end_id: int, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["bytes"] % WIDTH:
                    raise ValueError(f"{row['file']}: {row['bytes']} bytes are no whole number of ids")
                first = row["block"] * block
                ids = np.frombuffer(files.read(f"{folder}/{row['file']}", first * WIDTH, block * WIDTH), "<u2")
                found = np.flatnonzero(ids == end_id) + first
                yield pa.record_batch(
                    [pa.array([row["file"]]), pa.array([row["block"]], pa.int64()), pa.array([first + len(ids)], pa.int64()), pa.array([found], pa.list_(pa.int64()))],
                    ["file", "block", "stop", "ends"],
                )

    return run


def scan(file_names: DataFrame, folder: str, end_id: int, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, start, n_tokens, closed) of every document of the flat
    files named in column ``file``; ``start`` is a place in the file."""
    named = file_names.select("file").distinct()
    sized = named.repartition(file_names.sparkSession.sparkContext.defaultParallelism).mapInArrow(_sizes(folder), "file string, bytes long").filter("bytes > 0")
    blocks = sized.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("bytes") / (block * WIDTH)) - 1)))
    # rows of a few bytes would be put together into one task: the number of tasks is given
    total = blocks.count()
    tasks = max(-(-total // TASK_BLOCKS), file_names.sparkSession.sparkContext.defaultParallelism)
    found = blocks.repartition(max(1, min(total, tasks))).mapInArrow(_search(folder, end_id, block), "file string, block long, stop long, ends array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = found.select(
        "file",
        "stop",
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("done"),
        (F.coalesce(F.max(F.get("ends", F.size("ends") - 1)).over(before), F.lit(-1)) + 1).alias("open"),
        F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull().alias("last"),
        "ends",
    )
    starts = F.concat(F.array("open"), F.transform("ends", lambda e: e + 1))
    # the rest after a file's last separator closes with the file
    stops = F.when(F.col("last") & (F.element_at(starts, -1) < F.col("stop")), F.concat("ends", F.array("stop"))).otherwise(F.col("ends"))
    each = stitched.select("file", "done", "ends", starts.alias("starts"), F.posexplode(stops).alias("place", "end"))
    start = F.get("starts", F.col("place"))
    return each.select(
        "file",
        (F.col("done") + F.col("place")).cast("long").alias("ordinal"),
        start.alias("start"),
        (F.col("end") - start).alias("n_tokens"),
        (F.col("place") < F.size("ends")).alias("closed"),
    )


def token_counts(docs: DataFrame, tokenizer: str, end_id: int, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Tokens of every document, counted in flat files written from ``docs``:
    doc_id, file, ordinal, start, n_tokens (without the separator)."""
    with Scratch(docs.sparkSession, "token_counts") as scratch:
        folder = scratch.path("flat")
        order = scratch.table(write_flat(docs, folder, tokenizer, end_id, shard), "order")
        counted = scan(order.select("file"), folder, end_id, block)
        out = counted.join(order.hint("merge"), ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
        return scratch.keep(out, "result")
