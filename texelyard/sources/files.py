"""Scans over a directory of texture files."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texelyard.functions import formats, paths, rules
from texelyard.operators.assets import filter_formats
from texelyard.session import ship_package, stage
from texelyard.sources.listing import list_tree
from texelyard.spec import ALL_FORMATS

# Bytes of image data handed to Python per row, so batches stay small for any image.
BAND_BYTES = 1 << 14
ROWS_PER_BATCH = 1 << 16
# Bytes of image files that one task decodes; Spark counts a small file as 4 MB, so 32 of them would be a task and a staged file.
TASK_BYTES = 64 << 20

PASSED_OVER = "The image reader passed over this file"
PIXEL_SCHEMA = "texture_id bigint, width int, height int, mip int, x int, y int, r int, g int, b int, a int"


def format_glob(enabled) -> str:
    """File-name glob for the enabled formats, matching either letter case."""
    exts = [e for e, fmt in rules.FORMAT_OF_EXT.items() if fmt in enabled]
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e[1:]) for e in exts) + "}"


def strip_scheme(c):
    """Path without a leading scheme and authority."""
    return F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def _only_direct(df: DataFrame, folder: str) -> DataFrame:
    root = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", folder).rstrip("/")
    return df.filter(paths.parent(strip_scheme(F.col("path"))) == root)


def scan_assets(spark: SparkSession, folder: str, recursive: bool = True, enabled=None) -> DataFrame:
    """Files under ``folder``: path, length, modified. Contents are never read.

    Hidden names are listed as any other, see :func:`texelyard.sources.listing.list_tree`; what could not be listed
    has no length. With ``enabled`` only files of those formats are kept.
    """
    found = list_tree(spark, folder, recursive).drop("error")
    return found if enabled is None else filter_formats(found, enabled)


def share_of(shares: int):
    """Share of a texture, from 0, by the hash of its id."""
    return F.pmod(F.xxhash64("texture_id"), F.lit(shares)).cast("int")


def load_images(spark: SparkSession, folder: str, recursive: bool = True, enabled=ALL_FORMATS, shares: int | None = None):
    """Decode images; returns (pixel rows, outcome per file).

    With ``shares`` the first is a function from a share to its pixel rows, and bands are stored by share.

    Decoding is Spark's own image source; a listed file that it passes over, as it does hidden names, is
    an outcome without a result. Each image is cut into bands of rows
    before it reaches Python, so no batch depends on the size of an image. The
    bands are written to the shared folder: pixels and outcomes both read them,
    and no file is decoded twice.
    """
    ship_package(spark)
    reader = (
        spark.read.format("image")
        .option("dropInvalid", "false")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", format_glob(enabled))
    )
    images = reader.load(folder).select(F.col("image.origin").alias("path"), "image")
    images = filter_formats(images if recursive else _only_direct(images, folder), enabled)
    listed = scan_assets(spark, folder, recursive, enabled).select("path", "length")
    total = listed.agg(F.sum("length")).first()[0] or 0
    images = images.coalesce(max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES)))
    bands = images.selectExpr(
        "path",
        "xxhash64(path) AS texture_id",
        "image.width",
        "image.height",
        "image.nChannels AS channels",
        f"cast(greatest(1, {BAND_BYTES} div (image.width * image.nChannels)) AS int) AS rows",
        "image.data",
    ).selectExpr(
        "*",
        # A file that could not be decoded has a negative height and gives one row without data.
        "explode_outer(if(height > 0, sequence(0, height - 1, rows), null)) AS y0",
    )
    cut = "substring(data, y0 * width * channels + 1, rows * width * channels) AS data"
    cut_bands = bands.selectExpr("path", "texture_id", "width", "height", "channels", "y0", cut)
    staged = stage(cut_bands, "bands") if shares is None else stage(cut_bands.withColumn("share", share_of(shares)), "bands", "share")
    decoded = F.col("y0").isNotNull()
    outcome = staged.filter(~decoded | (F.col("y0") == 0)).select(
        "path",
        "texture_id",
        formats.classify_format(paths.ext(F.col("path"))).alias("file_format"),
        decoded.alias("has_result"),
        F.when(decoded, F.col("width")).alias("width"),
        F.when(decoded, F.col("height")).alias("height"),
        F.array().cast("array<string>").alias("issues"),
    )
    plain = strip_scheme(F.col("path"))
    passed = listed.withColumn("_plain", plain).join(outcome.select(plain.alias("_plain")), "_plain", "left_anti").select(
        "path",
        F.xxhash64("path").alias("texture_id"),
        formats.classify_format(paths.ext(F.col("path"))).alias("file_format"),
        F.lit(False).alias("has_result"),
        F.lit(None).cast("int").alias("width"),
        F.lit(None).cast("int").alias("height"),
        F.array(F.lit(PASSED_OVER)).alias("issues"),
    )
    outcome = outcome.unionByName(passed)

    def pixels(of: DataFrame) -> DataFrame:
        kept = of.filter(decoded).select("texture_id", "width", "height", "channels", "y0", "data")
        return kept.mapInArrow(_band_pixels, PIXEL_SCHEMA)

    return pixels(staged) if shares is None else (lambda share: pixels(staged.filter(F.col("share") == share))), outcome


def _band_pixels(batches):
    """Pixel rows of bands; stored bytes are B, G, R and maybe A, or one grey value."""
    held, rows = [], 0
    for batch in batches:
        for ident, width, height, channels, y0, data in zip(*[c.to_pylist() for c in batch.columns]):
            px = np.frombuffer(data, np.uint8).reshape(-1, channels).astype(np.int32)
            at = np.arange(len(px), dtype=np.int32)
            blue, green, red = (px[:, min(k, channels - 1)] for k in range(3))
            alpha = px[:, 3] if channels == 4 else np.full(len(px), 255, np.int32)
            same = [np.full(len(px), v, t) for v, t in ((ident, np.int64), (width, np.int32), (height, np.int32), (0, np.int32))]
            held.append([*same, at % width, y0 + at // width, red, green, blue, alpha])
            rows += len(px)
            if rows >= ROWS_PER_BATCH:
                yield _batch(held)
                held, rows = [], 0
    if held:
        yield _batch(held)


def _batch(parts):
    names = [field.split()[0] for field in PIXEL_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names)


def judge_loads(df: DataFrame) -> DataFrame:
    """Add ``success`` and the issues that are kept, from raw parser outcomes.

    Reads ``file_format, has_result, issues`` and, when present, ``from_buffer``
    and ``is_d4``. DDS and TEX read from a path fail on any issue, as do split
    TEX files; other loads fail only without a result, and a parser that fails
    in silence gets a generic issue. A null flag counts as false and a null format as
    unknown, so every row is either loaded or rejected.
    """
    fmt = F.coalesce("file_format", F.lit("Unknown"))
    buffered = F.coalesce("from_buffer", F.lit(False)) if "from_buffer" in df.columns else F.lit(False)
    d4 = (F.coalesce("is_d4", F.lit(False)) & (fmt == "TEX")) if "is_d4" in df.columns else F.lit(False)
    unsupported = fmt == "Unknown"
    strict = d4 | (fmt.isin("DDS", "TEX") & ~buffered)
    noisy = F.coalesce(F.size("issues"), F.lit(0)) > 0
    success = ~unsupported & F.coalesce("has_result", F.lit(False)) & ~(strict & noisy)
    none = F.array().cast("array<string>")
    generic = F.when(d4, F.array(F.lit("The split TEX parser gave no result"))).when(
        ~strict, F.array(F.concat(F.lit("The "), fmt, F.lit(" parser gave no result")))
    )
    kept = (
        F.when(unsupported, F.array(F.lit(rules.UNSUPPORTED_INPUT)))
        .when(success, none)
        .when(noisy, F.col("issues"))
        .otherwise(F.coalesce(generic, none))
    )
    return df.withColumns({"success": success, "issues": kept})


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Loaded rows and rejected rows, after :func:`judge_loads`."""
    judged = judge_loads(df)
    return judged.filter("success").drop("success"), judged.filter("NOT success").drop("success")
