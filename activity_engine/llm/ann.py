"""Nearest neighbours by an int8 block matrix join.

Queries and candidates are dealt into blocks, and each (query block,
candidate block) pair is one tile.  In a tile all inner products of the int8
vectors are one matrix product.  Quantisation moves a product by at most
``|q| |c - c'| + |q - q'| |c'|``, so every product has a lower and an upper
bound; candidates whose upper bound is below the k-th lower bound cannot be
among the nearest.  The survivors are recomputed from the original vectors
in double precision (``fsum``, so equal vectors tie exactly whatever their
place) and kept in a heap of k for each query; the tiles' heaps are merged
by a top-k window, whose map side keeps k rows a query.

Nothing is approximate: the bounds make the result that of brute force.

Cases: vectors that are null, zero or hold null or non-finite components
take no part, nor do rows with a null ``vec_id``; only vectors of equal
dimension are compared; rows with the query's own id are no candidates; a
repeated query id is asked once, with its least vector in byte order;
repeated candidate rows each take a rank; ties go to the smaller ``vec_id``;
fewer candidates than k give all of them; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch

QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 16384


def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, dims, full, small, scale, norm, error = [], [], [], [], [], [], []
        for i, x in zip(batch.column("vec_id").to_pylist(), batch.column("vector"), strict=True):
            if i is None or not x.is_valid or x.values.null_count:
                continue
            v = x.values.to_numpy().astype(np.float64)
            top = np.abs(v).max(initial=0.0)
            if not np.isfinite(top) or top == 0 or np.isnan(v).any():
                continue
            step = top / 127
            q = np.rint(v / step).astype(np.int8)
            ids.append(i)
            dims.append(len(v))
            full.append(v.tobytes())
            small.append(q.tobytes())
            scale.append(step)
            # lengths of the vector over its largest component, so that no square overflows
            norm.append(top * math.sqrt(math.fsum((v / top) ** 2)))
            error.append(top * math.sqrt(math.fsum((v / top - step / top * q) ** 2)))
        yield pa.record_batch(
            [
                pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(full, pa.binary()), pa.array(small, pa.binary()),
                pa.array(scale, pa.float64()), pa.array(norm, pa.float64()), pa.array(error, pa.float64()),
            ],
            ["vec_id", "dim", "vector", "small", "scale", "norm", "error"],
        )


def _rows(table: pa.Table, dim: int) -> tuple[np.ndarray, ...]:
    cat = lambda c, t: np.frombuffer(b"".join(table[c].to_pylist()), t).reshape(-1, dim)
    return table["vec_id"].to_numpy(), cat("vector", np.float64), cat("small", np.int8), *(table[c].to_numpy() for c in ("scale", "norm", "error"))


def _inner(a: np.ndarray, b: np.ndarray) -> float:
    """Inner product in double precision, infinite where it leaves the doubles."""
    with np.errstate(over="ignore"):
        parts = a * b
    try:
        if np.isfinite(parts).all():
            return math.fsum(parts)
    except OverflowError:
        pass
    up = [int(np.frexp(np.abs(x).max())[1]) for x in (a, b)]
    value = math.fsum(np.ldexp(a, -up[0]) * np.ldexp(b, -up[1]))
    try:
        return math.ldexp(value, sum(up))
    except OverflowError:
        return math.copysign(math.inf, value)


def _tile(k: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        query, rank, near, score = [], [], [], []
        dim = table["dim"][0].as_py()
        side = table["asks"].to_numpy(zero_copy_only=False)
        q_id, q_full, q_small, q_scale, q_norm, q_error = _rows(table.filter(pa.array(side)), dim)
        c_id, c_full, c_small, c_scale, c_norm, c_error = _rows(table.filter(pa.array(~side)), dim)
        exact = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64  # integers up to there are exact
        wide = c_small.T.astype(exact)
        # equal vectors are computed once
        _, one, same = np.unique(c_full.view(np.dtype((np.void, 8 * dim))).ravel(), return_index=True, return_inverse=True) if len(c_id) else (0, 0, 0)
        for i in range(len(q_id) if len(c_id) else 0):
            with np.errstate(over="ignore", invalid="ignore"):
                product = (q_small[i].astype(exact) @ wide).astype(np.float64) * (q_scale[i] * c_scale)
                bound = (q_norm[i] * c_error + q_error[i] * (c_norm + c_error)) * (1 + 1e-9) + 1e-12 * q_norm[i] * c_norm
                # beyond the doubles nothing is known of a pair
                low = np.nan_to_num(product - bound, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                high = np.nan_to_num(product + bound, nan=np.inf, posinf=np.inf, neginf=-np.inf)
            other = np.flatnonzero(c_id != q_id[i])
            if len(other) > k:
                least = np.partition(low[other], len(other) - k)[len(other) - k]
                other = other[high[other] >= least]
            values = {u: _inner(q_full[i], c_full[one[u]]) for u in set(same[other].tolist())} if len(other) else {}
            best = heapq.nsmallest(k, ((-values[same[j]], int(c_id[j])) for j in other.tolist()))
            query += [int(q_id[i])] * len(best)
            near += [b[1] for b in best]
            score += [-b[0] for b in best]
        return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(near, pa.int64()), "score": pa.array(score, pa.float64())})

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 20, vector: str = "embedding") -> DataFrame:
    """query_id, rank from 1, vec_id and score (inner product) of the ``k``
    nearest rows to each row of ``vectors`` for which ``queries`` holds."""
    spark = vectors.sparkSession
    with Scratch(spark, "nearest") as scratch:
        own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
        schema = "vec_id long, dim int, vector binary, small binary, scale double, norm double, error double"
        ready = scratch.table(own.mapInArrow(_quantise, schema), "vectors")
        asked = ready.filter(queries)
        asked = asked.groupBy("vec_id").agg(F.min(F.struct("vector", *[c for c in ready.columns if c not in ("vec_id", "vector")])).alias("_q"))
        asked = asked.select("vec_id", "_q.*").select(*ready.columns)
        n, n_asked = ready.count(), asked.count()
        q_blocks, c_blocks = max(1, -(-n_asked // QUERY_BLOCK)), max(1, -(-n // CANDIDATE_BLOCK))
        block = lambda blocks: F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int")
        each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        left = asked.select("*", F.lit(True).alias("asks"), block(q_blocks).alias("i")).withColumn("j", each(c_blocks))
        # repeated rows spread over the blocks too
        spread = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(c_blocks)).cast("int")
        right = ready.select("*", F.lit(False).alias("asks"), spread.alias("j")).withColumn("i", each(q_blocks))
        tiles = left.unionByName(right).groupBy("dim", "i", "j").applyInArrow(_tile(k), "query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        out = tiles.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return scratch.keep(out.select("query_id", "rank", "vec_id", "score"), "result")
