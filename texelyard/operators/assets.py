"""Row-wise operators on asset tables: classification, flags and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texelyard.functions import formats, kinds, paths
from texelyard.functions.lookups import as_col


def classify(df: DataFrame) -> DataFrame:
    """Add ``file_format`` from the extension of ``path``."""
    return df.withColumn("file_format", formats.classify_format(paths.ext(F.col("path"))))


def filter_formats(df: DataFrame, enabled) -> DataFrame:
    """Keep files whose format is enabled; unknown extensions never pass."""
    return df.filter(formats.classify_format(paths.ext(F.col("path"))).isin(sorted(enabled)))


def apply_kind(df: DataFrame, override=None) -> DataFrame:
    """Add ``kind`` and ``channel_kinds``; channel kinds exist for Multikind only.

    ``override`` is a kind name or a nullable column that beats the guess.
    """
    stem = F.col("_stem")
    kind = kinds.guess_kind(stem, F.col("pixel_format"))
    if override is not None:
        kind = F.coalesce(as_col(override), kind)
    tagged = df.withColumn("_stem", paths.stem(F.col("path"))).withColumn("kind", kind)
    multi = F.when(F.col("kind") == "Multikind", kinds.channel_kinds(stem))
    return tagged.withColumn("channel_kinds", multi).drop("_stem")


def review_flags(df: DataFrame) -> DataFrame:
    """Flag assets that need a decision by the user.

    Reads ``kind, pixel_format, file_format, is_d4, companion, issues``.
    """
    lacks_payload = (F.col("file_format") == "TEX") & F.col("is_d4") & (F.col("companion") == "none")
    return df.withColumns(
        {
            "needs_bc3n": (F.col("pixel_format") == "BC3") & (F.col("kind") == "Normal"),
            "needs_payload": lacks_payload & (F.size("issues") == 0),
        }
    )


def search(df: DataFrame, text: str, column: str = "path") -> DataFrame:
    """Case-insensitive substring filter; an empty text keeps everything."""
    if not text:
        return df
    needle = "".join(c.lower() if c.isascii() else c for c in text)
    return df.filter(F.contains(paths.ascii_lower(F.col(column)), F.lit(needle)))


def carry_metadata(derived: DataFrame, source: DataFrame) -> DataFrame:
    """Kind, sRGB flag and (Multikind only) channel kinds of the source asset, null without one."""
    meta = source.select(
        "texture_id",
        "kind",
        "srgb",
        F.when(F.col("kind") == "Multikind", F.col("channel_kinds")).alias("channel_kinds"),
    )
    return derived.drop("kind", "srgb", "channel_kinds").join(meta, "texture_id", "left")


def asset_details(df: DataFrame) -> DataFrame:
    """The details report: one row of readable properties per asset."""
    return df.select(
        "path",
        kinds.display_name(F.col("file_format"), "file_format").alias("file_format"),
        F.concat_ws(" x ", "width", "height").alias("dimensions"),
        F.when(F.col("depth") > 1, F.col("depth")).alias("depth"),
        kinds.display_name(F.col("type"), "type").alias("type"),
        kinds.display_name(F.col("pixel_format"), "pixel_format").alias("pixel_format"),
        kinds.display_name(F.col("kind"), "kind").alias("kind"),
        F.array_join(
            F.transform(F.col("channel_kinds"), lambda k: kinds.display_name(k, "kind")), ", "
        ).alias("channel_kinds"),
        F.when(F.col("srgb"), "Yes").otherwise("No").alias("srgb"),
        F.col("mip_count").alias("mip_levels"),
        "layers",
    )


def mip_geometry(df: DataFrame) -> DataFrame:
    """One row per stored level with its size in pixels and bytes."""
    levels = df.select(
        "texture_id",
        "pixel_format",
        "width",
        "height",
        F.explode(F.sequence(F.lit(0), F.col("mip_count") - 1)).alias("mip"),
    )
    sized = levels.select(
        "texture_id",
        "pixel_format",
        "mip",
        formats.level_size(F.col("width"), F.col("mip")).alias("width"),
        formats.level_size(F.col("height"), F.col("mip")).alias("height"),
    )
    size = formats.level_bytes(F.col("pixel_format"), F.col("width"), F.col("height"))
    return sized.select("texture_id", "mip", "width", "height", size.alias("bytes"))


def upscale_geometry(df: DataFrame, scale: int) -> DataFrame:
    return df.withColumns(
        {
            "width": F.col("width") * scale,
            "height": F.col("height") * scale,
            "mip_count": formats.upscaled_mips(F.col("mip_count"), scale),
        }
    )
