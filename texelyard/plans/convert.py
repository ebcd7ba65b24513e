"""Batch conversion as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texelyard.operators.mips import mip_chain
from texelyard.operators.pixels import CHANNELS, with_texture
from texelyard.operators.report import batch_summary
from texelyard.operators.steps import apply_step, apply_steps
from texelyard.plans.planning import PLAN_COLUMNS, batch_columns, mark_collisions
from texelyard.session import stage
from texelyard.sources.files import judge_loads, load_images, scan_assets, strip_scheme
from texelyard.sources.sinks import NO_MATCH, guard_sink, refuse_existing, write_converted
from texelyard.spec import JobSpec

DUPLICATE = "Another file has the same output path"


def settled_plan(assets: DataFrame, spec: JobSpec) -> DataFrame:
    """Plan with output collisions rejected, staged so it is computed once."""
    planned = batch_columns(assets, spec)
    kept = [c for c in PLAN_COLUMNS if c in planned.columns]
    marked = mark_collisions(planned.select(*kept), F.col("success"))
    settled = marked.withColumns(
        {
            "message": F.when(F.col("is_duplicate"), DUPLICATE).otherwise(F.col("message")),
            "success": F.col("success") & ~F.col("is_duplicate"),
        }
    ).drop("is_duplicate")
    return stage(settled, "plan")


def convert_pixels(plan: DataFrame, pixel_rows: DataFrame, spec: JobSpec) -> DataFrame:
    """Converted pixel rows of the assets the plan lets through.

    Levels are made only where the job asks for them or a step made the stored ones
    stale; else every stored level that the plan counts goes through. The plan
    side of the only join is a few columns per texture; Spark picks the join by
    its measured size.
    """
    wanted = plan.filter("success")
    columns = ["texture_id", "kind", "target_format", "out_mips", "invert_g", "swap_ra"]
    if any(s.type == "upscale" for s in spec.steps):
        columns.append("channel_kinds")
    stored = pixel_rows.select("texture_id", "width", "height", "mip", "x", "y", *CHANNELS)
    if not spec.steps and not spec.generate_mipmaps:
        return edit_channels(with_texture(stored, wanted.select(*columns)).filter(F.col("mip") < F.col("out_mips")))
    rows = with_texture(stored.filter(F.col("mip") == 0), wanted.select(*columns))
    deepest = wanted.agg(F.max("out_mips")).first()[0] or 1
    if not spec.generate_mipmaps:
        return edit_channels(apply_steps(rows, spec.steps, "out_mips", deepest).drop("channel_kinds"))
    for step in spec.steps:
        rows = apply_step(rows, step)
    return edit_channels(mip_chain(rows.drop("channel_kinds"), F.col("out_mips"), deepest_level=deepest))


def edit_channels(rows: DataFrame) -> DataFrame:
    """Green inversion and red/alpha exchange where the plan asks for them."""
    green = F.when(F.col("invert_g"), 255 - F.col("g")).otherwise(F.col("g"))
    red = F.when(F.col("swap_ra"), F.col("a")).otherwise(F.col("r"))
    alpha = F.when(F.col("swap_ra"), F.col("r")).otherwise(F.col("a"))
    return rows.withColumns({"r": red, "g": green, "a": alpha}).drop("invert_g", "swap_ra", "out_mips")


def convert(assets: DataFrame, pixel_rows: DataFrame, spec: JobSpec, overwrite: bool = False) -> DataFrame:
    """Plan, convert and write; returns the one-row batch summary."""
    plan = settled_plan(assets, spec)
    manifest = plan.filter("success").select("texture_id", "path", "target_format", "output_path")
    write_converted(convert_pixels(plan, pixel_rows, spec), manifest, spec.output_dir, overwrite)
    return batch_summary(plan)


def check_batch(spark: SparkSession, spec: JobSpec) -> None:
    """Raise when a batch over files may not start; from the listing, nothing is decoded."""
    reason = guard_sink(spark, spec.input_dir, spec.output_dir)
    if reason is None and scan_assets(spark, spec.input_dir, spec.recursive, spec.formats).isEmpty():
        reason = NO_MATCH
    if reason:
        raise ValueError(reason)


def load_assets(outcome: DataFrame) -> DataFrame:
    """Assets of a batch from the outcome of each file; files that did not load have a ``load_error``."""
    loads = judge_loads(outcome)
    failed = F.concat(F.lit("Failed to load: "), F.col("path"), F.array_join(
        F.transform("issues", lambda issue: F.concat(F.lit("\n  "), issue)), ""))
    return loads.select(
        "texture_id",
        strip_scheme(F.col("path")).alias("path"),
        F.lit("RGBA8").alias("pixel_format"),
        "width",
        "height",
        F.lit(1).alias("mip_count"),
        F.when(~F.col("success"), failed).alias("load_error"),
    )


def convert_files(spark: SparkSession, spec: JobSpec, overwrite: bool = False) -> DataFrame:
    """Batch over a directory of image files; raises when the batch may not start."""
    check_batch(spark, spec)
    if not overwrite:
        refuse_existing(spark, spec.output_dir)
    pixel_rows, outcome = load_images(spark, spec.input_dir, spec.recursive, spec.formats)
    return convert(load_assets(outcome), pixel_rows, spec, overwrite)
