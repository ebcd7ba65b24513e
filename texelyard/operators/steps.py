"""Ordered transform steps with per-asset failure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texelyard.functions import formats, rules
from texelyard.operators import mips, pixels
from texelyard.operators.pixels import with_texture
from texelyard.spec import Step


def fold_geometry(width: Column, height: Column, mip_count: Column, steps) -> dict:
    """Size, level count and first failing step after ``steps``, from sizes alone.

    ``failed_step`` is null when every step applies.
    """
    failed = F.lit(None).cast("int")
    for number, step in enumerate(steps):
        if step.type == "downscale":
            fits = formats.can_downscale(width, height, step.levels)
            failed = F.coalesce(failed, F.when(~fits, number))
            width, height = F.shiftright(width, step.levels), F.shiftright(height, step.levels)
            mip_count = F.greatest(F.lit(1), mip_count - step.levels)
        else:
            mip_count = formats.upscaled_mips(mip_count, step.scale)
            width, height = width * step.scale, height * step.scale
    return {"width": width, "height": height, "mip_count": mip_count, "failed_step": failed}


def apply_step(df: DataFrame, step: Step) -> DataFrame:
    if step.type == "downscale":
        return mips.downscale(df, step.levels)
    return pixels.upscale(df, step.scale, step.alpha)


def apply_steps(df: DataFrame, steps, levels: str, deepest_level: int) -> DataFrame:
    """Apply steps to level-0 rows and give each texture ``levels`` levels in the end.

    ``levels`` names the column with the level count after all steps, at most
    ``deepest_level``. Only the last step decides the levels below level 0: a
    downscale keeps those of the chain it drops from, an upscale makes them anew.
    """
    *first, last = steps
    for step in first:
        df = apply_step(df, step)
    if last.type == "downscale":
        rows = mips.downscale(df, last.levels, levels=F.col(levels) + last.levels, deepest_level=deepest_level + last.levels)
    else:
        rows = mips.mip_chain(apply_step(df, last), F.col(levels), deepest_level=deepest_level)
    return rows


def run_steps(textures: DataFrame, pixel_rows: DataFrame, steps) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply steps to assets; returns (done, failed, pixels of the done ones).

    A step fails on sizes only, and pixel rows carry theirs, so failing assets
    are filtered out of the pixels up front: no join per step. One join brings
    the level counts, and the rows have as many levels as ``mip_count`` says.
    """
    after = fold_geometry(F.col("width"), F.col("height"), F.col("mip_count"), steps)
    status = textures.withColumn("failed_step", after["failed_step"])
    failed = status.filter(F.col("failed_step").isNotNull()).withColumn("message", F.lit(rules.TOO_SMALL))
    sides = {c: after[c] for c in ("width", "height", "mip_count")}
    done = status.filter(F.col("failed_step").isNull()).drop("failed_step").withColumns(sides)
    guard = fold_geometry(F.col("width"), F.col("height"), F.lit(1), steps)["failed_step"]
    rows = pixel_rows.filter(((F.col("mip") == 0) & guard.isNull()) if steps else F.lit(True))
    if steps:
        counted = with_texture(rows, done.select("texture_id", F.col("mip_count").alias("_levels")))
        deepest = done.agg(F.max("mip_count")).first()[0] or 1
        rows = apply_steps(counted, steps, "_levels", deepest).drop("_levels")
    return done, failed, rows


def with_working_format(df: DataFrame, op: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``op`` with block-compressed assets labelled by their working format.

    Afterwards the format label and the kind columns are as they were.
    """
    kept = [c for c in ("pixel_format", "kind", "srgb", "channel_kinds") if c in df.columns]
    saved = df.withColumns({f"_{c}": F.col(c) for c in kept})
    compressed = formats.is_bcn(F.col("pixel_format"))
    work = F.when(compressed, formats.working_format(F.col("pixel_format"))).otherwise(F.col("pixel_format"))
    done = op(saved.withColumn("pixel_format", work))
    # Formats that are not block-compressed keep what the operation gave them.
    original = F.when(formats.is_bcn(F.col("_pixel_format")), F.col("_pixel_format")).otherwise(F.col("pixel_format"))
    restored = {c: original if c == "pixel_format" else F.col(f"_{c}") for c in kept}
    return done.withColumns(restored).drop(*[f"_{c}" for c in kept])
