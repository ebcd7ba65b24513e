"""Running totals that stay parallel when one group holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_A_TASK = 1 << 18  # a task sorts so many rows, whatever the size of the table


def blocked_running_sum(
    df: DataFrame,
    group: str,
    block: Column,
    order: list,
    value: Column,
    before: str,
    total: str | None = None,
) -> DataFrame:
    """Add ``before``: the sum of ``value`` over earlier rows of the same group.

    ``block`` must grow with ``order`` (rows of a lower block come first), so a
    group of any size is cut into blocks. Rows are shuffled once by (group,
    block), into as many tasks as a count of ``df`` asks for; only one partial sum per block is summed over the
    group as a whole. ``df`` is read three times and should be a table or staged.
    ``total`` names an optional column with the sum over the group.
    """
    # A key of two values that are never null: window and join then share one exchange,
    # and rows without a group or block keep their own running sum.
    key = ["_group", "_no_group", "_block", "_no_block"]
    kind = df.schema[group].dataType
    spare = F.lit("") if kind.typeName() == "string" else F.lit(0)
    rows = df.withColumns({"_value": value, "_at": block}).withColumns(
        {
            "_group": F.coalesce(F.col(group), spare.cast(kind)),
            "_no_group": F.isnull(group),
            "_block": F.coalesce(F.col("_at").cast("long"), F.lit(0)),
            "_no_block": F.isnull("_at"),
        }
    )
    sums = rows.groupBy(*key).agg(F.sum("_value").alias("_sum"))
    per_group = Window.partitionBy("_group", "_no_group")
    earlier = per_group.orderBy(F.desc("_no_block"), "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *key,
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_sum").over(per_group).alias("_total"),
    )
    inside = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # Without a number of its own the shuffle's tasks would be sized by compressed bytes, several times less than they sort.
    dealt = rows.repartition(max(1, -(-df.count() // ROWS_A_TASK)), *key)
    local = dealt.withColumn("_local", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    joined = local.join(offsets, key)
    out = [F.col(c) for c in df.columns] + [(F.col("_offset") + F.col("_local")).alias(before)]
    if total:
        out.append(F.col("_total").alias(total))
    return joined.select(*out)
