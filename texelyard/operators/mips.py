"""Mip levels of pixel rows.

Each level carries exact channel sums and pixel counts, so a value is rounded
once however deep the chain is. Level ``k`` of a pixel is found in closed form:
``least(x >> k, (width >> k) - 1)``, which folds an odd last column inwards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texelyard.functions.formats import can_downscale, max_mips
from texelyard.functions.lookups import as_col
from texelyard.operators.pixels import CHANNELS, with_texture

ROW = ("width", "height", "levels", "mip", "x", "y", *CHANNELS, "n", "size", "sums", "deep")

# Both sides travel as one BIGINT of two whole INTs, current level and number of levels
# as one INT. With the level read from data, every level of a chain runs the same
# generated code.
PACKED_SIZE = ("shiftleft(cast(width AS bigint), 32) + height AS size", "levels AS deep")
WIDTH = "shiftright(size, 32)"
HEIGHT = "(size & 4294967295)"
LEVEL = "shiftright(deep, 6)"
LEVELS = "(deep & 63)"


def _keys(df: DataFrame) -> list:
    """The texture and its other properties, which are equal on all its pixels."""
    return [c for c in df.columns if c not in ROW]


def _base(df: DataFrame, levels) -> DataFrame:
    """Level 0 with sums, counts and the number of levels wanted."""
    full = max_mips(F.col("width"), F.col("height"))
    wanted = full if levels is None else F.least(F.greatest(as_col(levels), F.lit(1)), full)
    sums = F.expr(f"struct({', '.join(f'cast({c} AS bigint) AS {c}' for c in CHANNELS)}, 1L AS n)")
    rows = df.filter("mip = 0").withColumn("levels", wanted).withColumn("sums", sums)
    return rows.selectExpr(*_keys(df), *PACKED_SIZE, "x", "y", "sums.*")


def _fold(df: DataFrame, by: int) -> DataFrame:
    """Sums ``by`` levels coarser.

    The size is aggregated rather than grouped by: no later filter on it can be
    pushed below the exchange, so all branches of a chain reuse the same one.
    """

    def folded(axis, side):
        last = f"cast(greatest(1, shiftright({side}, {LEVEL} + {by})) - 1 AS int)"
        return F.expr(f"least(shiftright({axis}, {by}), {last})").alias(axis)

    return df.groupBy(*_keys(df), folded("x", WIDTH), folded("y", HEIGHT)).agg(
        F.expr("max(size) AS size"), F.expr(f"max(deep) + {by * 64} AS deep"), *[F.expr(f"sum({c}) AS {c}") for c in (*CHANNELS, "n")]
    )


def _unit_normal(channel: str) -> str:
    """One component of the normalised mean vector, as 0..255."""
    v = {c: f"({c} / n / 255 * 2 - 1)" for c in "rgb"}
    length = f"sqrt({v['r']} * {v['r']} + {v['g']} * {v['g']} + {v['b']} * {v['b']})"
    flat = "1.0D" if channel == "b" else "0.0D"
    unit = f"(CASE WHEN {length} > 0 THEN {v[channel]} / {length} ELSE {flat} END + 1) / 2"
    return f"cast(floor(least(greatest({unit} * 255 + 0.5D, 0.0D), 255.0D)) AS int)"


def _values(df: DataFrame, normals: bool) -> DataFrame:
    """Pixel rows of one level from its sums; ``normals`` renormalises normal maps."""
    mean = {c: f"cast(({c} * 2 + n) div (n * 2) AS int)" for c in CHANNELS}
    if normals and "kind" in df.columns:
        mean |= {c: f"CASE WHEN kind = 'Normal' THEN {_unit_normal(c)} ELSE {mean[c]} END" for c in "rgb"}
    channels = [f"{mean[c]} AS {c}" for c in CHANNELS]
    sides = [f"cast({WIDTH} AS int) AS width", f"cast({HEIGHT} AS int) AS height"]
    return df.selectExpr(*_keys(df), *sides, f"{LEVEL} AS mip", "x", "y", *channels)


def deepest(df: DataFrame) -> int:
    """Levels of the largest texture: one number from a map-side combined maximum."""
    return df.agg(F.max(max_mips(F.col("width"), F.col("height")))).first()[0] or 1


def mip_chain(df: DataFrame, levels=None, normals: bool = True, deepest_level: int | None = None) -> DataFrame:
    """Regenerate mip levels from level 0; other levels are dropped first.

    ``levels`` is a number, a column or None for the full chain, always clamped
    to what the texture allows; ``deepest_level``, if known, saves looking up the
    largest texture. Each level is grouped from the one before, on
    the full position, so a single huge texture spreads over all tasks and every
    shuffle is about a quarter of the last. Normal maps are renormalised.
    """
    if deepest_level is None:
        deepest_level = deepest(df)
        if isinstance(levels, int):
            deepest_level = min(max(levels, 1), deepest_level)
    sums = _base(df, levels)
    out = [_values(sums, False)]
    for _ in range(1, deepest_level):
        sums = _fold(sums, 1)
        out.append(_values(sums.filter(f"{LEVELS} > {LEVEL}"), normals))
    return reduce(DataFrame.unionAll, out)


def downscale(df: DataFrame, drop: int, normals: bool = True, levels=None, deepest_level: int = 0) -> DataFrame:
    """Halve sides ``drop`` times: level ``drop`` becomes level 0.

    One aggregate straight from level 0, combined on the map side. With ``levels``,
    the texture's level count before, the levels below follow, each folded from
    the one above; ``deepest_level`` is the largest such count. Textures too small
    for it are left out; :func:`texelyard.operators.steps.run_steps` reports them.
    """
    fits = df.filter(can_downscale(F.col("width"), F.col("height"), drop))
    sums = _fold(_base(fits, 1 if levels is None else levels), drop)
    out = [_values(sums, normals)]
    for _ in range(drop + 1, deepest_level):
        sums = _fold(sums, 1)
        out.append(_values(sums.filter(f"{LEVELS} > {LEVEL}"), normals))
    return reduce(DataFrame.unionAll, out).withColumns(
        {
            "width": F.shiftright("width", drop),
            "height": F.shiftright("height", drop),
            "mip": F.col("mip") - drop,
        }
    )


def select_mip(df: DataFrame, index: int, levels: str | None = None) -> DataFrame:
    """One level per texture, the last available when ``index`` is past it.

    Rows deeper than ``index`` are filtered at the scan; what is left to find is
    the deepest remaining level per texture, one row each. ``levels`` names a
    column that holds a texture's stored level count: with it nothing is joined.
    """
    upto = df.filter(F.col("mip") <= index)
    if levels:
        return upto.filter(F.col("mip") == F.least(F.lit(index), F.col(levels) - 1))
    last = upto.groupBy("texture_id").agg(F.max("mip").alias("_last"))
    return with_texture(upto, last).filter(F.col("mip") == F.col("_last")).drop("_last").select(*df.columns)
