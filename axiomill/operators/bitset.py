"""A filter of fixed size: which rows of a large table may match a list of keys, told before any exchange.

The list becomes one array of 64-bit words, one bit a key, whatever its length; a
scan tests one bit a row in generated code. It lets through every row that
matches, and others as the list fills the array, so an exact join has to follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 17  # 64-bit words: 1 MB, 8 million bits


def bits_of(keys: DataFrame, slots: int = SLOTS) -> DataFrame:
    """One row (bits) of the 64-bit keys in the only column of a frame."""
    h = keys.select(F.pmod(F.col(keys.columns[0]), F.lit(slots * 64)).alias("h")).distinct()
    some = h.select(F.floor(F.col("h") / 64).cast("int").alias("slot"), F.expr("shiftleft(1L, cast(h % 64 as int))").alias("bits"))
    none = keys.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"), F.lit(0).cast("bigint").alias("bits"))
    words = some.unionByName(none).groupBy("slot").agg(F.bit_or("bits").alias("bits"))
    return words.agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "bits"))), lambda x: x["bits"]).alias("bits"))


def may_be_in(key: Column, bits: DataFrame, slots: int = SLOTS) -> Column:
    """Whether a 64-bit key may be among those of ``bits_of``; false only if it is not."""
    h = F.pmod(key, F.lit(slots * 64))
    word = F.get(bits.scalar(), F.floor(h / 64).cast("int"))
    return F.getbit(word, (h % 64).cast("int")) == 1
