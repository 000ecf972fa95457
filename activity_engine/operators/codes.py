"""Value-to-code tables for columns with any number of values (M-1, M-6).

A fitted StringIndexer holds every label in the driver and ships them with the
model.  Here the dictionary is a table (column, value, n, code), written once:
the distinct values are dealt by ranges of (column, order), each range numbers
its own rows, and a range's first code is the number of rows of its column in
the ranges before it.  Only those counts, a row for each range and column, are
put together in one place.  Encoding is a join to the table, without a hint: a
small dictionary is broadcast at its measured size, a large one is shuffled,
and ``salts`` splits a value that a third of the rows hold.

Nulls have no code and stay null; a column without values has no rows; values
are compared as strings, in code-point order.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

# monotonically_increasing_id: partition in the upper bits, row in the lower 33
_ROW_BITS = 33


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct non-null values of each column and their rows: (column, value, n)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols])
    return count_pairs(df.select(F.inline(pairs)))


def count_pairs(pairs: DataFrame) -> DataFrame:
    """``value_counts`` of rows (column, value)."""
    return pairs.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def build_codes(df: DataFrame, cols: list[str], order: str = "alphabet") -> DataFrame:
    """The dictionary of ``cols`` of ``df``: ``number_codes`` of their values."""
    return number_codes(value_counts(df, cols), order)


def number_codes(counts: DataFrame, order: str = "alphabet") -> DataFrame:
    """The dictionary of counted values as a written table (column, value, n, code).

    Codes of each column run from 0: by value (``alphabet``), or by falling
    number of rows, ties by value (``frequency``).
    """
    if order not in ("alphabet", "frequency"):
        raise ValueError(f"order is alphabet or frequency, not {order!r}")
    keys: list[str | Column] = ["column"] + ([F.desc("n")] if order == "frequency" else []) + ["value"]
    dealt = counts.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    # written, so that the ranges do not change between the two readings
    numbered = materialize(
        dealt.withColumn("_range", F.shiftright(at, _ROW_BITS)).withColumn("_row", at.bitwiseAND((1 << _ROW_BITS) - 1)), "codes"
    )
    ranges = numbered.groupBy("column", "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy("column").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("column", "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start"))
    # a row for each range and column: bounded by partitions x columns
    coded = numbered.join(F.broadcast(starts), ["column", "_range"])
    return coded.select("column", "value", "n", (F.col("_start") + F.col("_row")).alias("code"))


def encode(df: DataFrame, codes: DataFrame, cols: dict[str, str], unseen: str = "null", salts: int = 1) -> DataFrame:
    """``df`` with the code (bigint) of each column of ``cols`` under its new name.

    ``unseen`` values (not in the dictionary) get null, or with ``keep`` the
    number of codes of their column, or with ``error`` end the job.  ``salts``
    above 1 deals the rows of each value over so many keys and repeats the
    dictionary as often.
    """
    if unseen not in ("null", "keep", "error"):
        raise ValueError(f"unseen is null, keep or error, not {unseen!r}")
    if clash := set(cols.values()) & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are there already")
    return functools.reduce(lambda out, c: _encode_one(out, codes, c, cols[c], unseen, salts), cols, df)


def _encode_one(df: DataFrame, codes: DataFrame, col: str, out: str, unseen: str, salts: int) -> DataFrame:
    names = [f"_{out}_{part}" for part in ("value", "code", "salt")]
    if clash := set(names) & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are used by the encoding")
    value, code, salt = names
    one = codes.filter(F.col("column") == col).select(F.col("value").alias(value), F.col("code").alias(code))
    on = F.col(f"`{col}`").cast("string") == F.col(value)
    if salts > 1:
        df = df.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(salts)))
        other = f"{salt}_of"
        one = one.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        on = on & (F.col(salt) == F.col(other))
        names.append(other)
    found: Column = F.col(code)
    missed = F.col(f"`{col}`").isNotNull() & found.isNull()
    if unseen == "keep":
        found = F.when(missed, F.lit(codes.filter(F.col("column") == col).count())).otherwise(found)
    elif unseen == "error":
        found = F.when(missed, F.raise_error(F.concat(F.lit(f"no code for {col}: "), F.col(f"`{col}`").cast("string"))).cast("long")).otherwise(found)
    return df.join(one, on, "left").withColumn(out, found).drop(*names)
