"""A Bloom filter of wanted keys, as a column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = 4
BITS_A_KEY = 12  # about one in 150 unwanted keys passes
MOST_BITS = 1 << 26  # 8 MB, whatever the number of keys; more keys only let more pass


def might_contain(wanted: DataFrame, key: Column, count: int) -> Column:
    """Whether ``key`` may be among the only column of ``wanted``; false only for keys that are not.

    ``count`` is about the number of keys. The bits are made by one aggregation and reach the tasks as a value of a
    one-row subquery, of a size fixed by ``count`` and never over ``MOST_BITS``.
    """
    bits = min(MOST_BITS, max(64, 1 << (max(1, BITS_A_KEY * count) - 1).bit_length()))

    def spots(value: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(value, F.lit(k)), F.lit(bits)) for k in range(HASHES)]

    spread = wanted.select(F.explode(F.array(*spots(F.col(wanted.columns[0])))).alias("spot"))
    word = F.shiftright("spot", 6).cast("int")
    words = spread.groupBy(word.alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(spot & 63 AS int)))").alias("held"))
    every = wanted.sparkSession.range(bits >> 6).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("bigint").alias("held"))
    dense = words.unionAll(every).groupBy("word").agg(F.expr("bit_or(held)").alias("held"))
    table = dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "held"))), lambda w: w["held"]).alias("t")).scalar()
    found = F.lit(True)
    for spot in spots(key):
        held = F.get(table, F.shiftright(spot, 6).cast("int"))
        found = found & (F.call_function("shiftright", held, spot.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1)
    return found
