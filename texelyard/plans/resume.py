"""Batches that can be stopped, resumed and watched.

A batch is cut into shares by texture. Each share is an attempt: its pixels are written, then its manifest, then it is
committed. A batch that is run again makes only outputs that no commit holds. Outputs of another batch in the same
folder are kept unless the caller lets them be replaced, each by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from texelyard.functions.lookups import as_col
from texelyard.operators.report import batch_summary
from texelyard.plans.convert import check_batch, convert_pixels, load_assets, settled_plan
from texelyard.session import stage
from texelyard.sources.commits import committed, new_attempt, publish_next
from texelyard.sources.files import load_images, share_of
from texelyard.sources.listing import exists
from texelyard.spec import JobSpec

KEPT = "The output of another batch was kept"
PIXELS = (
    "texture_id bigint, width int, height int, mip int, x int, y int, r int, g int, b int, a int, kind string, "
    "attempt string, target_format string"
)
MANIFEST = "texture_id bigint, path string, target_format string, output_path string, options string, attempt string"
_FIELDS = [field.split()[0] for field in MANIFEST.split(", ")]


@dataclass(frozen=True)
class Snapshot:
    """How far a batch is; ``processed`` counts inputs that are converted, kept from before, or rejected."""

    total: int
    processed: int
    success: int
    fail: int

    @property
    def done(self) -> bool:
        return self.processed >= self.total

    @property
    def fraction(self) -> float:
        return self.processed / self.total if self.total else 0.0


def options_digest(spec: JobSpec) -> str:
    """Digest of all options that decide what an output holds; equal in every process."""
    chosen = {k: sorted(v) if isinstance(v, frozenset) else v for k, v in asdict(spec).items() if k != "output_dir"}
    return hashlib.sha256(repr(sorted(chosen.items())).encode()).hexdigest()


def held_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest rows of all commits with their ``number``, replaced outputs included."""
    if not exists(spark, f"{folder}/manifest"):
        return spark.createDataFrame([], f"{MANIFEST}, number bigint")
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    return rows.join(committed(spark, folder), "attempt").select(*_FIELDS, "number")


def outputs(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of a folder: per output path the row of its last commit."""
    rest = [c for c in (*_FIELDS, "number") if c != "output_path"]
    last = held_outputs(spark, folder).groupBy("output_path").agg(F.max_by(F.struct(*rest), "number").alias("_last"))
    return last.select("output_path", "_last.*")


def converted_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """Pixel rows of all outputs of a folder.

    Uncommitted attempts drop out by their folder; of the rest only rows that a later commit replaced are looked up.
    """
    if not exists(spark, f"{folder}/pixels"):
        return spark.createDataFrame([], PIXELS).drop("attempt")
    rows = spark.read.schema(PIXELS).parquet(f"{folder}/pixels")
    visible = rows.join(committed(spark, folder).select("attempt"), "attempt", "left_semi")
    last = outputs(spark, folder).select("output_path", F.col("number").alias("_last"))
    replaced = held_outputs(spark, folder).join(last, "output_path").filter("number < _last")
    return visible.join(replaced.select("attempt", "texture_id"), ["attempt", "texture_id"], "left_anti").drop("attempt")


def judge_outputs(plan: DataFrame, spec: JobSpec, replace: bool | Column = False) -> DataFrame:
    """The plan with ``state``: rejected, open, made (by this batch before), or kept (another batch's, see :data:`KEPT`).

    An output is this batch's if its options and its input are the same. ``replace`` is a condition on the plan's
    columns and on ``held_path``, the input that the output was made from.
    """
    there = outputs(plan.sparkSession, spec.output_dir).select(
        "output_path", F.col("options").alias("_options"), F.col("texture_id").alias("_owner"), F.col("path").alias("held_path")
    )
    mine = (F.col("_options") == options_digest(spec)) & (F.col("_owner") == F.col("texture_id"))
    state = (
        F.when(~F.col("success"), "rejected")
        .when(F.col("_options").isNull(), "open")
        .when(mine, "made")
        .when(F.coalesce(as_col(replace), F.lit(False)), "open")
        .otherwise("kept")
    )
    judged = plan.join(there, "output_path", "left").withColumn("state", state)
    return judged.withColumn("message", F.when(F.col("state") == "kept", KEPT).otherwise(F.col("message"))).select(*plan.columns, "held_path", "state")


def convert_shares(
    assets: DataFrame,
    pixel_rows: DataFrame | Callable[[int], DataFrame],
    spec: JobSpec,
    shares: int = 16,
    replace: bool | Column = False,
    at_most: int | None = None,
    told: Callable[[Snapshot], None] | None = None,
) -> DataFrame:
    """Convert what is missing, share by share; returns the one-row summary of the whole batch.

    ``pixel_rows`` is a table, which every share reads, or a function from a share to its rows (see
    :func:`texelyard.sources.files.share_of`). At most ``at_most`` shares are made; the rest count as not processed.
    ``told`` gets a snapshot at the start and after each commit. An empty batch has nothing to do and is done.
    """
    spark, folder = assets.sparkSession, spec.output_dir
    judged = judge_outputs(settled_plan(assets, spec), spec, replace).withColumn("share", share_of(shares))
    judged = stage(judged, "judged")
    counts = judged.groupBy("state", F.when(F.col("state") == "open", F.col("share")).alias("share")).count().collect()
    sizes = {r.share: r["count"] for r in counts if r.state == "open"}
    known = {state: sum(r["count"] for r in counts if r.state == state) for state in ("rejected", "kept", "made")}
    total, fail, success = sum(r["count"] for r in counts), known["rejected"] + known["kept"], known["made"]

    def tell():
        if told:
            told(Snapshot(total, success + fail, success, fail))

    tell()
    finished = sorted(sizes)[:at_most]
    for share in finished:
        rows = pixel_rows(share) if callable(pixel_rows) else pixel_rows
        success += _convert_share(judged.filter((F.col("state") == "open") & (F.col("share") == share)), rows, spec, folder)
        tell()
    through = (F.col("state") == "made") | ((F.col("state") == "open") & F.col("share").isin(finished))
    outcome = F.when(F.col("state").isin("rejected", "kept"), False).when(through, True)
    return batch_summary(judged.withColumn("success", outcome))


def _convert_share(plan: DataFrame, pixel_rows: DataFrame, spec: JobSpec, folder: str) -> int:
    """Write and commit one attempt; returns its number of outputs, as observed while they were written."""
    attempt, seen = new_attempt(), Observation()
    names = [c for c in (field.split()[0] for field in PIXELS.split(", ")) if c != "attempt"]
    converted = convert_pixels(plan, pixel_rows, spec).select(*names)
    converted.write.partitionBy("target_format").parquet(f"{folder}/pixels/attempt={attempt}")
    manifest = plan.withColumn("options", F.lit(options_digest(spec))).select(*[c for c in _FIELDS if c != "attempt"])
    manifest.observe(seen, F.count(F.lit(1)).alias("outputs")).write.parquet(f"{folder}/manifest/attempt={attempt}")
    publish_next(plan.sparkSession, folder, attempt)
    return seen.get["outputs"]


def convert_files_resumable(
    spark: SparkSession,
    spec: JobSpec,
    shares: int = 16,
    replace: bool | Column = False,
    at_most: int | None = None,
    told: Callable[[Snapshot], None] | None = None,
) -> DataFrame:
    """:func:`convert_shares` over a folder of image files; raises when the batch may not start.

    Decoded bands are staged by share, so each share reads its own. A resumed batch decodes its files again.
    """
    check_batch(spark, spec)
    pixel_rows, outcome = load_images(spark, spec.input_dir, spec.recursive, spec.formats, shares)
    return convert_shares(load_assets(outcome), pixel_rows, spec, shares, replace, at_most, told)
