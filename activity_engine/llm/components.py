"""Connected components by alternating large-star and small-star.

Every round is two joins and two grouped minima over the edge table, written
to the shared folder, so a lost executor costs one round at most.  A hub of a
large component is one key with many edges: its minimum is aggregated before
the shuffle, and the join back is one row per key against the edges, which
adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the least node around it (as
    many edges out as in)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _stars_only(edges: DataFrame) -> bool:
    """Is every node either the end of one edge or a centre, never both?"""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("child")), F.struct(F.col("v").alias("n"), F.lit(0).alias("child")))).alias("e"))
    node = ends.groupBy("e.n").agg(F.sum("e.child").alias("up"), F.min("e.child").alias("low"))
    return node.filter("up > 1 OR (up = 1 AND low = 0)").isEmpty()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of ``links`` (longs ``a``, ``b``); the
    component is the smallest node reachable.  Self-links, repeated links and
    links with a null end are ignored; no links give no rows."""
    edges = links.filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    round_ = 0
    while True:
        edges = scratch.table(_small_star(_large_star(edges)), f"{name}-{round_}")
        if round_:
            scratch.drop(f"{name}-{round_ - 1}")
        if _stars_only(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        round_ += 1
