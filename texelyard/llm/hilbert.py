"""Shards as runs along a Hilbert curve through several metadata dimensions.

Each document gets a cell: language, source and text length, four bits each. The
Hilbert index of the cell orders documents so that neighbours on the curve are
neighbours in every dimension; equal runs of that order are the shards. A file of
such a run spans few values of each dimension, so minimum and maximum statistics
prune it by any of them. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from texelyard.llm.common import free_name, partitions, quoted

BITS = 4
HEX = "0123456789abcdef"
# A cell is cut by digits of its rows' digests until a slice is about this small.
SLICE_LEAST, SLICE_MOST, DEPTH_MOST = 256, 100_000, 7


def name_code(value: Column) -> Column:
    """Four bits of a name: equal names agree, null is the empty name."""
    return F.instr(F.lit(HEX), F.substring(F.md5(F.coalesce(value.cast("string"), F.lit(""))), 1, 1)) - 1


def length_code(value: Column) -> Column:
    """Four bits of a length: its power of two, from 0 for null, negative and 0 to 15."""
    whole = F.greatest(F.coalesce(value.cast("long"), F.lit(0)), F.lit(0))
    return F.least(F.length(F.bin(whole + 1)) - 1, F.lit(15))


def curve_index(axes: list[str], bits: int = BITS) -> Column:
    """Hilbert index of integer columns of ``bits`` bits each, as a long.

    The transposed form is undone axis by axis from the highest bit and then Gray
    coded (J. Skilling, Programming the Hilbert curve, 2004). Array functions hold
    the coordinates, so the expression does not grow with the number of steps.
    """
    steps = ", ".join(f"named_struct('q', {1 << k}, 'i', {i})" for k in range(bits - 1, 0, -1) for i in range(len(axes)))
    start = ", ".join(f"cast({a} AS INT)" for a in axes)
    levels = ", ".join(str(1 << k) for k in range(bits - 1, 0, -1))
    undone = (
        "transform(x, (v, j) -> CASE WHEN (x[s.i] & s.q) <> 0 THEN IF(j = 0, v ^ (s.q - 1), v)"
        " WHEN j = 0 OR j = s.i THEN v ^ ((x[0] ^ x[s.i]) & (s.q - 1)) ELSE v END)"
    )
    gray = "transform(x, (v, j) -> aggregate(slice(x, 1, j + 1), 0, (a, b) -> a ^ b))"
    flip = f"aggregate(array({levels}), 0, (t, q) -> IF((y[{len(axes) - 1}] & q) <> 0, t ^ (q - 1), t))"
    woven = f"aggregate(sequence({bits - 1}, 0, -1), 0L, (h, l) -> aggregate(y, h, (g, v) -> g * 2 + (shiftright(v ^ {flip}, l) & 1)))"
    return F.expr(f"aggregate(array({steps}), array({start}), (x, s) -> {undone}, x -> transform(array({gray}), y -> {woven})[0])")


def curve_shards(
    docs: DataFrame, shards: int = 8, key: str = "doc_id", axes: dict[str, Column] | None = None,
    keep: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per document with its place: ``curve``, ``shard`` and ``slot`` in the shard from 0.

    Law: counts of rows per shard differ by one at most. Order within a cell is by
    the digest of the key and the kept values as text, then the key, then the kept values, nulls first; rows
    equal in all of these can change places without a difference. ``keep`` names what a row
    carries (default: all columns of ``docs``); an added column whose name is taken gets a
    trailing underscore. Nulls fall in the cell of empty names and of length 0.
    An empty table gives no rows.

    The 4,096 cells are counted first, and the table of cells is the only thing
    broadcast. A cell with many rows is cut by leading digits of the digests,
    as many as its count needs, so a language, source or key (null too) with a third of all rows
    spreads over every task; only rows alike in everything stay together. Only what ``keep`` names is shuffled, once.
    """
    axes = axes or {"lang": name_code(quoted("lang")), "source": name_code(quoted("source")), "n_chars": length_code(quoted("n_chars"))}
    if BITS * len(axes) > 14:
        raise ValueError("too many cells to broadcast")
    keep = {c: quoted(c) for c in docs.columns} if keep is None else keep
    coded = [a.alias(f"_c{k}") for k, a in enumerate(axes.values())]
    cell = [f"_c{k}" for k in range(len(axes))]
    held = [F.coalesce(c.cast("string"), F.lit("")) for c in (quoted(key), *keep.values())]
    digest = F.md5(F.concat_ws(":", *held)).alias("_digest")

    all_cells = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    counted = docs.select(*coded).groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).withColumn("_curve", curve_index(cell))
    counted = counted.withColumns(
        {
            "_all": F.sum("_n").over(all_cells),
            "_before": F.coalesce(F.sum("_n").over(W.orderBy("_curve").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        }
    )
    aim = F.greatest(F.lit(SLICE_LEAST), F.least(F.lit(SLICE_MOST), F.expr(f"_all div {8 * partitions(docs.sparkSession)}")))
    depth = sum(((F.col("_n") > aim * 16**k).cast("int") for k in range(DEPTH_MOST)), F.lit(0))
    cells = F.broadcast(counted.withColumn("_depth", depth).drop("_n"))
    prefix = F.expr("substring(_digest, 1, _depth)")

    sliced = docs.select(*coded, digest).join(cells, cell).select("_curve", prefix.alias("_slice"))
    slices = sliced.groupBy("_curve", "_slice").agg(F.count(F.lit(1)).alias("_m"))
    ahead = W.partitionBy("_curve").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.select("_curve", "_slice", F.coalesce(F.sum("_m").over(ahead), F.lit(0)).alias("_skip"))

    packed = F.struct(*[c.alias(n) for n, c in keep.items()]).alias("_kept")
    rows = docs.select(*coded, digest, quoted(key).alias("_key"), packed).join(cells, cell)
    rows = rows.withColumn("_slice", prefix)
    within = W.partitionBy("_curve", "_slice").orderBy("_digest", "_key", "_kept")
    placed = rows.withColumn("_row", F.row_number().over(within)).join(slices, ["_curve", "_slice"])
    rank = F.col("_before") + F.col("_skip") + F.col("_row") - 1
    placed = placed.withColumn("_rank", rank).withColumn("_shard", F.expr(f"({shards} * (_rank + 1) - 1) div _all"))
    slot = F.expr(f"_rank - (_shard * _all) div {shards}")
    added = {"curve": F.col("_curve"), "shard": F.col("_shard").cast("int"), "slot": slot}
    return placed.select("_kept.*", *[c.alias(free_name(n, list(keep))) for n, c in added.items()])


def write_shards(docs: DataFrame, folder: str, shards: int = 8, key: str = "doc_id", axes: dict[str, Column] | None = None) -> None:
    """Write whole rows as Parquet, a folder per shard, each file one run of the curve."""
    placed = curve_shards(docs, shards, key, axes)
    shard, slot = placed.columns[-2:]
    dealt = placed.repartitionByRange(partitions(docs.sparkSession), shard, slot).sortWithinPartitions(shard, slot)
    dealt.write.mode("errorifexists").partitionBy(shard).parquet(folder)
