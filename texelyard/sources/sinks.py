"""Checked writing of conversion results."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texelyard.sources.listing import exists

NO_INPUT = "The batch has no input folder"
NO_OUTPUT = "The batch has no output folder"
MISSING_INPUT = "The input folder is not there"
SAME_FOLDER = "Input and output are one and the same folder"
NO_MATCH = "The input folder holds no file of the wanted formats"


def _plain(folder: str) -> str:
    """Folder without a ``file:`` scheme, doubled or trailing slashes."""
    return re.sub(r"/+", "/", re.sub(r"^file:(//)?", "", folder)).rstrip("/")


def guard_sink(spark: SparkSession, input_dir: str, output_dir: str, matches: DataFrame | None = None) -> str | None:
    """First reason not to start a batch, or None."""
    if not input_dir:
        return NO_INPUT
    if not output_dir:
        return NO_OUTPUT
    if not exists(spark, input_dir):
        return MISSING_INPUT
    if _plain(input_dir) == _plain(output_dir):
        return SAME_FOLDER
    if matches is not None and matches.isEmpty():
        return NO_MATCH
    return None


def refuse_existing(spark: SparkSession, folder: str) -> None:
    """Raise if a batch has been written to ``folder`` before."""
    for part in ("pixels", "manifest"):
        if exists(spark, f"{folder}/{part}"):
            raise FileExistsError(f"{folder} already exists: it holds the output of another batch")


def write_converted(pixel_rows: DataFrame, manifest: DataFrame, folder: str, overwrite: bool = False) -> DataFrame:
    """Write converted pixels and the manifest of planned output paths.

    Pixels go to one folder per target format and are not shuffled for it, so a
    format that holds most rows stays spread over all tasks. The manifest maps
    ``texture_id`` to ``output_path`` and is written last, so there is none for pixels
    that failed. Existing output is an error unless ``overwrite`` is confirmed. Returns rows written per target format.
    """
    mode = "overwrite" if overwrite else "errorifexists"
    if not overwrite:
        refuse_existing(manifest.sparkSession, folder)
    pixel_rows.write.mode(mode).partitionBy("target_format").parquet(f"{folder}/pixels")
    manifest.write.mode(mode).parquet(f"{folder}/manifest")
    written = manifest.sparkSession.read.parquet(f"{folder}/pixels")
    return written.groupBy("target_format").agg(F.count(F.lit(1)).alias("pixels"))
