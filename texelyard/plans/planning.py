"""One row per asset with everything the writer needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texelyard.functions import formats, kinds, paths, rules
from texelyard.functions.lookups import as_col
from texelyard.operators import assets as asset_ops
from texelyard.operators.steps import fold_geometry
from texelyard.spec import JobSpec


def _rgba8_if_bcn(fmt: Column) -> Column:
    return F.when(formats.is_bcn(fmt), "RGBA8").otherwise(fmt)


def blp_columns(current: Column, version, encoding) -> dict:
    """Container, encoding and pixel format of a BLP target."""
    version, encoding = as_col(version), as_col(encoding)
    target = formats.blp_target(encoding)
    return {
        "blp_version": formats.blp_version_name(version, encoding),
        "blp_encoding": formats.blp_encoding_code(encoding),
        "intermediate_format": current,
        "target_format": target,
        "needs_convert": current != target,
    }


def dds_columns(current: Column, dds_format: Column, invert_y: Column) -> dict:
    """Pixel format of a DDS target and the channel edits before it.

    Swapped normal maps pass through RGBA8; inverting does so for
    block-compressed sources only.
    """
    swapped = dds_format == rules.DDS_BC3N
    edited = F.when(swapped, "RGBA8").when(invert_y, _rgba8_if_bcn(current)).otherwise(current)
    target = formats.dds_target(dds_format)
    return {
        "invert_g": invert_y,
        "swap_ra": swapped,
        "intermediate_format": edited,
        "target_format": target,
        "needs_convert": edited != target,
    }


def _writer_options(spec: JobSpec) -> dict:
    """Encoder settings by output format; none for formats that take none."""
    jpeg = {"jpeg_quality": F.lit(spec.jpeg_quality), "jpeg_progressive": F.lit(spec.jpeg_progressive)}
    dither = {"dither": F.lit(spec.blp_dither), "dither_strength": F.lit(spec.blp_dither_strength)}
    return {"BLP": dither | jpeg, "JPEG": jpeg}.get(rules.OUTPUT_FORMATS[spec.output_format], {})


def plan_blp(df: DataFrame, spec: JobSpec) -> DataFrame:
    planned = df.withColumns(blp_columns(F.col("pixel_format"), spec.blp_version, spec.blp_encoding))
    return planned.withColumns(_writer_options(spec))


def dds_choice(kind: Column, spec: JobSpec) -> tuple[Column, Column]:
    """DDS format index and green inversion: one for all, or by kind."""
    if spec.dds_mode != 1:
        return F.lit(spec.dds_format_general), F.lit(spec.dds_invert_y_general)
    normal = kind == "Normal"
    chosen = (
        F.when(normal, spec.dds_format_normal)
        .when(kinds.is_channel_map(kind), spec.dds_format_channel)
        .otherwise(spec.dds_format_other)
    )
    return chosen, normal & F.lit(spec.dds_invert_y_normal)


def plan_dds(df: DataFrame, spec: JobSpec) -> DataFrame:
    dds_format, invert_y = dds_choice(F.col("kind"), spec)
    planned = df.withColumn("dds_format", dds_format)
    return planned.withColumns(dds_columns(F.col("pixel_format"), F.col("dds_format"), invert_y))


def output_path(path: Column, spec: JobSpec) -> Column:
    """Planned path: below the output folder in the input's layout, or flat."""
    name = F.concat(paths.raw_stem(path), F.lit(rules.OUTPUT_EXTENSIONS[spec.output_format]))
    sub = paths.relative_parent(path, spec.input_dir) if spec.keep_layout else F.lit("")
    return paths.join_path(spec.output_dir.rstrip("/"), sub, name)


def plan_output(df: DataFrame, spec: JobSpec) -> DataFrame:
    return df.withColumn("output_path", output_path(F.col("path"), spec))


def mark_collisions(plan: DataFrame, among: Column | None = None) -> DataFrame:
    """Add ``is_duplicate``: another asset has the same output and goes before this one.

    The lowest path per output goes first, of equal paths the lowest id. With
    ``among`` only rows for which it holds take part; the others are no duplicates. The winner is
    a map-side combined minimum, joined back on path and id, so a name
    shared by many files is no hot join key.
    """
    taking = F.lit(True) if among is None else F.coalesce(among, F.lit(False))
    key = [c for c in ("path", "texture_id") if c in plan.columns]
    winners = plan.filter(taking).groupBy("output_path").agg(F.min(F.struct(*key)).alias("_first"))
    marked = plan.join(winners.select("_first.*", F.lit(True).alias("_won")), key, "left")
    return marked.withColumn("is_duplicate", taking & F.col("_won").isNull()).select(*plan.columns, "is_duplicate")


PLAN_COLUMNS = (
    "texture_id",
    "path",
    "file_format",
    "kind",
    "channel_kinds",
    "pixel_format",
    "working_format",
    "out_width",
    "out_height",
    "out_mips",
    "output_format",
    "blp_version",
    "blp_encoding",
    "dither",
    "dither_strength",
    "jpeg_quality",
    "jpeg_progressive",
    "invert_g",
    "swap_ra",
    "intermediate_format",
    "target_format",
    "needs_convert",
    "output_path",
    "success",
    "message",
)


def batch_plan(assets: DataFrame, spec: JobSpec) -> DataFrame:
    """Plan of a batch, see :func:`batch_columns`."""
    planned = batch_columns(assets, spec)
    return planned.select(*[c for c in PLAN_COLUMNS if c in planned.columns])


def batch_columns(assets: DataFrame, spec: JobSpec) -> DataFrame:
    """Assets with all planning columns: a chain of projections, no shuffle.

    Reads ``texture_id, path, pixel_format, width, height, mip_count`` and, when
    present, ``load_error``. ``success`` is false for assets that cannot be
    converted, with the reason in ``message``.
    """
    kept = asset_ops.classify(asset_ops.filter_formats(assets, spec.formats))
    tagged = asset_ops.apply_kind(kept)
    after = fold_geometry(F.col("width"), F.col("height"), F.col("mip_count"), spec.steps)
    fmt = F.col("pixel_format")
    edited = any(s.type == "downscale" for s in spec.steps)
    work = F.when(formats.is_bcn(fmt), formats.working_format(fmt)).otherwise(fmt) if edited else fmt
    stepped = F.lit("RGBA8") if any(s.type == "upscale" for s in spec.steps) else fmt
    sized = tagged.withColumns(
        {
            "out_width": after["width"],
            "out_height": after["height"],
            "step_mips": after["mip_count"],
            "failed_step": after["failed_step"],
            "working_format": work,
            "_format": _rgba8_if_bcn(stepped) if spec.generate_mipmaps else stepped,
        }
    )
    wanted = F.lit(0)
    if spec.generate_mipmaps:
        wanted = formats.effective_mips(
            spec.mipmap_mode, spec.mipmap_custom_count, F.col("out_width"), F.col("out_height")
        )
    current = F.col("_format")
    name = rules.OUTPUT_FORMATS[spec.output_format]
    edits = {"invert_g": F.lit(False), "swap_ra": F.lit(False)}
    if name == "BLP":
        chosen = blp_columns(current, spec.blp_version, spec.blp_encoding)
    elif name == "DDS":
        chosen = dds_columns(current, *dds_choice(F.col("kind"), spec))
    else:
        target = _rgba8_if_bcn(current)
        chosen = {"intermediate_format": current, "target_format": target, "needs_convert": current != target}
    load_error = F.col("load_error") if "load_error" in assets.columns else F.lit(None).cast("string")
    message = F.coalesce(load_error, F.when(F.col("failed_step").isNotNull(), rules.TOO_SMALL))
    options = _writer_options(spec)
    planned = sized.withColumns(edits | chosen | options | {"_wanted": wanted, "message": message}).withColumns(
        {
            "out_mips": F.when(F.col("_wanted") > 0, F.col("_wanted")).otherwise(F.col("step_mips")),
            "success": F.col("message").isNull(),
        }
    )
    # Sizes past a failed step mean nothing.
    sizes = ("out_width", "out_height", "out_mips")
    planned = planned.withColumns({c: F.when(F.col("success"), F.col(c)) for c in sizes})
    return plan_output(planned.withColumn("output_format", F.lit(name)), spec)
