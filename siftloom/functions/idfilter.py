"""A filter of bounded size for ids: which rows of a large table could have one of some ids, without a shuffle.

The ids set bits of a hashed bitmap that is aggregated into 64-bit words and joined by broadcast. Its size grows with
the number of ids only up to MOST_BITS; beyond that it lets more rows through, and a join afterwards decides anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the smallest and the largest bitmap, as powers of two (the largest has a million words), bits for each id.
LEAST_BITS, MOST_BITS, BITS_PER_ID = 16, 26, 8


def bits_for(ids: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (BITS_PER_ID * ids).bit_length()))


def _place(key: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << bits))


def _marked(df: DataFrame, key: str, ids: DataFrame, count: int | None) -> DataFrame:
    """df with _in: whether the key may stand in ids."""
    bits = bits_for(ids.count() if count is None else count)
    words = ids.where(F.col(key).isNotNull()).select(_place(key, bits).alias("_p")).groupBy(F.shiftright("_p", 6).alias("_w")).agg(F.expr("bit_or(shiftleft(1L, cast(_p & 63 as int)))").alias("_b"))
    placed = df.withColumn("_p", _place(key, bits)).withColumn("_w", F.shiftright("_p", 6))
    return placed.join(F.broadcast(words), "_w", "left").withColumn("_in", F.expr("_b is not null and shiftright(_b, cast(_p & 63 as int)) & 1 = 1"))


def maybe_in(df: DataFrame, key: str, ids: DataFrame, count: int | None = None) -> DataFrame:
    """The rows of df whose key may stand in ids (one column of that name): all that do, few that don't.

    count is the number of ids if the caller knows it.
    """
    return _marked(df, key, ids, count).where("_in").select(*df.columns)


def without(df: DataFrame, key: str, ids: DataFrame, count: int | None = None) -> DataFrame:
    """The rows of df whose key does not stand in ids; only those that may stand there are shuffled."""
    marked = _marked(df, key, ids, count)
    sure = marked.where("not _in").select(*df.columns)
    # an anti join would be pushed below the filter and shuffle every row
    gone = ids.select(key).distinct().withColumn("_gone", F.lit(True))
    return sure.unionAll(marked.where("_in").join(gone, key, "left").where("_gone is null").select(*df.columns))
