"""Semi-join behind a Bloom filter (P-5, J-5).

A semi-join of all events with a small share of the users shuffles all events.
The filter is a table of 64-bit words: a key's hash picks a word and sets four
of its bits, ``bit_or`` puts the keys of a word together.  Events look up their
word in the broadcast table while they are scanned, so those of other users
(all but a percent or so) end there; the exact semi-join follows.

The table has a word for every four keys, up to ``MAX_WORDS``.  Past that the
same words take more keys and let more rows through; the result never changes.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

KEYS_A_WORD = 4
BITS_A_KEY = 4
MAX_WORDS = 1 << 20  # rows of two longs: 16 MB, some 48 MB as a hash table


def _hash(key: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), key)


def _mask(key: Column) -> Column:
    """Four bits of the word, six hash bits for each."""
    h = _hash(key, 1)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(BITS_A_KEY)]
    return functools.reduce(lambda x, y: x.bitwiseOR(y), bits)


def _word(key: Column, words: int) -> Column:
    return F.pmod(_hash(key, 2), F.lit(words))


def build_filter(keys: DataFrame, key: str, words: int) -> DataFrame:
    """The words that hold a key: (_word, _bits), at most ``words`` rows."""
    k = F.col(f"`{key}`")
    return keys.filter(k.isNotNull()).groupBy(_word(k, words).alias("_word")).agg(F.bit_or(_mask(k)).alias("_bits"))


def prefilter(df: DataFrame, bits: DataFrame, key: str, words: int) -> DataFrame:
    """Rows of ``df`` whose key may be in the filter; no key of it is lost."""
    k = df[f"`{key}`"]
    may = (bits["_word"] == _word(k, words)) & (bits["_bits"].bitwiseAND(_mask(k)) == _mask(k))
    return df.join(F.broadcast(bits), may, "left_semi")


def filtered_semi_join(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is among ``keys`` (a frame with that column,
    repeats and nulls allowed; a null matches nothing).

    The distinct keys are written once: counted, made into the filter, and
    joined.
    """
    distinct = materialize(keys.select(key).filter(F.col(f"`{key}`").isNotNull()).distinct(), "bloom_keys")
    words = min(MAX_WORDS, max(1, distinct.count() // KEYS_A_WORD))
    return prefilter(df, build_filter(distinct, key, words), key, words).join(distinct, key, "left_semi")
