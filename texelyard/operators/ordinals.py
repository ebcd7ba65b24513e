"""Positions in a total order, without gathering rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from texelyard.session import stage

ROW_BITS = 33  # of monotonically_increasing_id: the row's number in its partition


def with_ordinals(df: DataFrame, order: list[Column], name: str = "ordinal", parts: int | None = None) -> DataFrame:
    """``df`` and each row's position from 0 in ``order``; rows equal in all of it may change places.

    Rows are dealt by ranges of the order, each task sorts its range, and the numbered rows are
    written to the shared folder, so that counts and rows come from one and the same sort.
    Only the number of rows of each range is added up in one task. Rows that are equal in the whole order lie
    in one range: name a last column that tells them apart where many can be.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at, part, ahead = (f"_{name}_{c}" for c in ("at", "part", "ahead"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    staged = stage(dealt.withColumn(at, F.monotonically_increasing_id()), "ordinals").withColumn(part, F.shiftright(at, ROW_BITS))
    counts = staged.groupBy(part).agg(F.count(F.lit(1)).alias(ahead))
    before = F.coalesce(F.sum(ahead).over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(part, before.alias(ahead))
    # One row per range: never more than ``parts``.
    joined = staged.join(F.broadcast(counts), part)
    here = F.col(at).bitwiseAND((1 << ROW_BITS) - 1)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(ahead) + here).alias(name))
