"""Narrow operators on pixel rows (texture_id, width, height, mip, x, y, r, g, b, a)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texelyard.functions import rules
from texelyard.functions.colour import to_signed, to_u8
from texelyard.functions.lookups import as_col

CHANNELS = ("r", "g", "b", "a")
BAND_BITS = 6  # pixel rows per join band: 64
SALTS = 32  # what a texture's bands are dealt to, whatever its height


def with_texture(df: DataFrame, textures: DataFrame) -> DataFrame:
    """Join per-texture columns that pixel rows lack onto pixel rows of any level.

    The key is the texture and a band of rows modulo a fixed number, the texture
    side being repeated once for each. A shuffled join then spreads a huge texture
    over many tasks, the aggregations after it cannot inherit a partitioning that
    keeps each texture in one task, and no pixel is lost to a wrong or missing
    height.
    """
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    held = [c for c in textures.columns if c in df.columns and c != "texture_id"]
    keyed = textures.drop(*held).withColumn("_band", F.explode(salts))
    band = F.pmod(F.shiftright("y", BAND_BITS), F.lit(SALTS))
    return df.withColumn("_band", band).join(keyed, ["texture_id", "_band"]).drop("_band")


def swap(df: DataFrame, one: str, two: str) -> DataFrame:
    return df.withColumns({one: F.col(two), two: F.col(one)})


def invert(df: DataFrame, channel: str) -> DataFrame:
    return df.withColumn(channel, 255 - F.col(channel))


def bc3n_pack(df: DataFrame, invert_y: bool = False) -> DataFrame:
    """Channel order of swapped normal maps: R and A change places, G inverted on request."""
    return swap(invert(df, "g") if invert_y else df, "r", "a")


def bc3n_unpack(df: DataFrame) -> DataFrame:
    """Back from the swapped order; G is always inverted."""
    return invert(swap(df, "r", "a"), "g")


def channel_filter(df: DataFrame, r: bool = True, g: bool = True, b: bool = True, a: bool = True) -> DataFrame:
    """Show chosen channels: one alone as grey, hidden colours as 0, hidden alpha as 255."""
    shown = dict(zip(CHANNELS, (r, g, b, a)))
    active = [c for c, on in shown.items() if on]
    if len(active) == 4:
        return df
    if len(active) == 1:
        only = F.col(active[0])
        return df.withColumns({"r": only, "g": only, "b": only, "a": F.lit(255)})
    return df.withColumns({c: F.lit(255 if c == "a" else 0) for c, on in shown.items() if not on})


def expand_display(df: DataFrame) -> DataFrame:
    """Single-channel formats are shown as grey."""
    single = F.col("pixel_format").isin(rules.SINGLE_CHANNEL_FORMATS)
    return df.withColumns({c: F.when(single, F.col("r")).otherwise(F.col(c)) for c in ("g", "b")})


def rebuilt_z(r: Column, g: Column) -> Column:
    """Blue value of a unit normal given its red and green values."""
    nx, ny = to_signed(r), to_signed(g)
    z = F.sqrt(F.greatest(F.lit(0.0), 1 - nx * nx - ny * ny))
    return F.floor((z + 1) / 2 * 255 + 0.5).cast("int")


def expand_normal(df: DataFrame) -> DataFrame:
    """Rebuild the third component of normal maps."""
    normal = F.col("kind") == "Normal"
    return df.withColumn("b", F.when(normal, rebuilt_z(F.col("r"), F.col("g"))).otherwise(F.col("b")))


def display_texture(df: DataFrame) -> DataFrame:
    """What a viewer shows: rebuilt normals, else greyed single-channel formats."""
    normal = F.col("kind") == "Normal"
    single = F.col("pixel_format").isin(rules.SINGLE_CHANNEL_FORMATS)
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return df.withColumns(
        {
            "g": F.when(~normal & single, r).otherwise(g),
            "b": F.when(normal, rebuilt_z(r, g)).when(single, r).otherwise(b),
        }
    )


def fill_unused(df: DataFrame, default=0.0) -> DataFrame:
    """Channels of kind Unused get the channel default (0..1): one for all, or a mapping by channel."""
    given = default if isinstance(default, dict) else dict.fromkeys(CHANNELS, default)
    unused = [F.coalesce(F.element_at("channel_kinds", i + 1) == "Unused", F.lit(False)) for i in range(4)]
    filled = {c: to_u8(as_col(given.get(c, 0.0))) for c in CHANNELS}
    return df.withColumns({c: F.when(unused[i], filled[c]).otherwise(F.col(c)) for i, c in enumerate(CHANNELS)})


def upscale(df: DataFrame, scale: int, alpha: bool = False, default=0.0) -> DataFrame:
    """Enlarge level 0 by an integer factor, each pixel repeated.

    Multikind channels stay independent and unused ones are filled; otherwise
    alpha is kept on request and opaque if not. Every pixel row fans out where
    it is, so nothing is shuffled.
    """
    base = df.filter(F.col("mip") == 0)
    if "kind" in df.columns:
        multi = F.col("kind") == "Multikind"
        base = fill_unused(base, default) if "channel_kinds" in df.columns else base
        keep_alpha = multi | F.lit(alpha)
    else:
        keep_alpha = F.lit(alpha)
    grown = base.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(scale * scale - 1))))
    k = F.col("_k")
    return grown.withColumns(
        {
            "x": F.col("x") * scale + k % scale,
            "y": F.col("y") * scale + F.floor(k / scale).cast("int"),
            "a": F.when(keep_alpha, F.col("a")).otherwise(255),
            "width": F.col("width") * scale,
            "height": F.col("height") * scale,
        }
    ).drop("_k")
