"""A filter over 64-bit keys, to thin rows before an exact join.

Two bits per key, from its lower and its upper half, built by a distributed ``bit_or`` and held
by every executor until the operator's scratch block is left.  It has no
false negatives; a false positive only sends a row to the exact join that
always follows, so results never depend on the size.  The size is chosen from
the number of keys (``PER_KEY`` bits for each, so few rows are let through in
vain) up to ``most`` bits, a parameter of every operator that uses one: 2**28
bits are 32 MB, the proven bound of the broadcast.  Beyond ``most / PER_KEY``
keys it thins less and less, and the rows go to the exact join by shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

PER_KEY = 32
LEAST_BITS, MOST_BITS = 12, 28  # powers of two


def bits_for(keys: int, most: int = MOST_BITS) -> int:
    """Power of two of the bits for so many keys."""
    return max(min(LEAST_BITS, most), min(most, int(keys * PER_KEY).bit_length()))


def build(keys: DataFrame, column: str, scratch: Scratch, most: int = MOST_BITS) -> Broadcast:
    """Broadcast bitmap of the non-null longs in ``column`` of a written table; it
    is destroyed with the scratch block."""
    keys = keys.filter(F.col(column).isNotNull())
    bits = bits_for(keys.count(), most)
    places = F.array(F.col(column), F.shiftrightunsigned(column, 32))
    at = keys.select(F.explode(places).alias("at")).select(F.col("at").bitwiseAND((1 << bits) - 1).alias("at"))
    cell = F.shiftright("at", 6).cast("int")
    rows = at.groupBy(cell.alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bit")).toArrow()
    cells = np.zeros(1 << (bits - 6), dtype=np.uint64)
    if rows.num_rows:
        cells[rows["cell"].to_numpy()] = rows["bit"].to_numpy().view(np.uint64)
    return scratch.own(keys.sparkSession.sparkContext.broadcast(cells))


def _bit(cells: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(len(cells) * 64 - 1)
    return (cells[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def contains(cells: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each 64-bit key: may it be among those of the bitmap?"""
    keys = keys.view(np.uint64)
    found = _bit(cells, keys)
    some = np.flatnonzero(found)
    found[some] = _bit(cells, keys[some] >> np.uint64(32))
    return found
