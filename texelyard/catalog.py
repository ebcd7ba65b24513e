"""Registered queries: every operator over the whole of its derived view."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texelyard import fixtures as fx
from texelyard.functions import binary, colour, formats, kinds, paths, rules
from texelyard.operators import assets as ops
from texelyard.operators import companions, mips, packed, report, steps, tiles
from texelyard.operators import pixels as px
from texelyard.operators.ordinals import with_ordinals
from texelyard.plans import convert as conversion
from texelyard.plans import jobs, planning, resume
from texelyard.session import new_folder, stage
from texelyard.sources import archive, files, ranged, sinks
from texelyard.spec import CUSTOM, MAXIMUM, JobSpec, Step
from texelyard.streaming import recent

PIXEL = ["texture_id", "width", "height", "mip", "x", "y", "r", "g", "b", "a"]

BLP_SPEC = JobSpec(output_format=0, blp_version=1, blp_encoding=5, blp_dither=True)
DDS_SPEC = JobSpec(output_format=2, dds_mode=1, dds_format_normal=8, dds_invert_y_normal=True)
PLAN_SPEC = JobSpec(
    input_dir="base/meta",
    output_dir="out",
    formats=frozenset({"BLP", "BMP", "DDS", "JPEG", "PNG", "TEX"}),
    dds_mode=1,
    dds_format_normal=8,
    dds_invert_y_normal=True,
    generate_mipmaps=True,
    mipmap_mode=CUSTOM,
    mipmap_custom_count=6,
    steps=(Step("downscale", levels=2), Step("upscale", scale=2)),
)
TWO_STEPS = (Step("downscale", levels=2), Step("upscale", scale=3, alpha=True), Step("downscale", levels=1))


# -- scans, sources, sinks ---------------------------------------------------


def classify_count(spark: SparkSession, d: str) -> DataFrame:
    tagged = ops.apply_kind(ops.classify(fx.assets(spark, d)))
    return tagged.groupBy("file_format", "kind").agg(F.count(F.lit(1)).alias("n"))


def scan_assets(spark, d):
    found = files.scan_assets(spark, fx.write_bitmaps(spark, d), enabled={"BMP", "DDS"})
    return found.select(paths.file_name(F.col("path")).alias("name"), "length")


def scan_all(spark, d):
    """A whole tree, hidden names included."""
    folder = fx.write_tree(spark, d)
    inside = F.substring_index("path", folder.rsplit("/", 1)[1] + "/", -1)
    return files.scan_assets(spark, folder).select(inside.alias("name"), "length")


def supported_listing_ranked(spark, d):
    """The sorted listing with each entry's position, so that the order itself is a value."""
    return with_ordinals(archive.texture_entries(fx.listing(spark, d)), [F.asc("path")], "position")


def load_images(spark, d):
    rows, outcome = files.load_images(spark, fx.write_bitmaps(spark, d))
    named = outcome.select("texture_id", paths.file_name(F.col("path")).alias("name"))
    return rows.join(named, "texture_id").select("name", *PIXEL[1:])


def load_outcomes(spark, d):
    _, outcome = files.load_images(spark, fx.write_bitmaps(spark, d))
    judged = files.judge_loads(outcome)
    return judged.select(
        paths.file_name(F.col("path")).alias("name"), "file_format", "success", "width", "height",
        F.array_join("issues", "|").alias("issues"),
    )


def filter_formats(spark, d):
    return ops.filter_formats(fx.assets(spark, d), {"DDS", "JPEG", "TEX"}).select("texture_id", "path")


def supported_listing(spark, d):
    return archive.supported_listing(fx.listing(spark, d))


def toc_textures(spark, d):
    return archive.toc_textures(fx.toc(spark, d)).select("name", "sno")


def packed_files(spark, d):
    return archive.packed_files(fx.dat_names(spark, d))


def packed_index(spark, d):
    return packed.packed_index(fx.packed_blobs(spark, d))


def packed_offsets(spark, d):
    return packed.packed_offsets(fx.packed(spark, d))


def last_writer(spark, d):
    return packed.last_writer(packed.packed_offsets(fx.packed(spark, d)))


def _load_rows(spark, d):
    key = F.col("texture_id")
    noisy = F.when(key % 3 == 0, F.array(F.lit("bad mip"), F.concat(F.lit("row "), key)))
    return ops.classify(fx.assets(spark, d)).select(
        "texture_id",
        "file_format",
        (key % 4 != 0).alias("has_result"),
        F.coalesce(noisy, F.array().cast("array<string>")).alias("issues"),
        (key % 7 == 0).alias("from_buffer"),
        (key % 2 == 0).alias("is_d4"),
    )


def split_rejects(spark, d):
    ok, bad = files.split_rejects(_load_rows(spark, d))

    def show(df, success):
        return df.select("texture_id", F.lit(success).alias("success"), F.array_join("issues", "|").alias("issues"))

    return show(ok, True).unionAll(show(bad, False))


def issue_report(spark, d):
    _, bad = files.split_rejects(_load_rows(spark, d))
    told = report.issue_report(bad.withColumn("message", F.concat(F.lit("Failed to load: "), F.col("texture_id"))))
    return told.select("texture_id", "message")


def extract_slice(spark, d):
    cut = fx.packed_blobs(spark, d).withColumns({"start": F.lit(8), "size": F.lit(8), "format_hash": F.col("l_partkey") * 1000})
    data = archive.slice_with_header(cut, fx.HEADER_MAGIC)
    return data.select("f", "l_partkey", F.hex("data").alias("data"))


def strip_header(spark, d):
    key = F.col("p_partkey")
    magic = F.when(key % 2 == 0, F.lit(fx.HEADER_MAGIC)).otherwise(key)
    blob = F.unhex(F.concat(binary.le_hex(magic), F.repeat(F.lit("00"), 10 + (key % 5).cast("int")), binary.le_hex(key)))
    rows = fx.table(spark, d, "part").select("p_partkey", blob.alias("blob"))
    return rows.select("p_partkey", F.hex(binary.strip_header(F.col("blob"), fx.HEADER_MAGIC)).alias("data"))


def write_converted(spark, d):
    folder = new_folder(spark, "written")
    rows = fx.pixels(spark, d).withColumn("target_format", F.col("pixel_format")).select(*PIXEL, "target_format")
    manifest = planning.plan_output(fx.pixel_assets(spark, d), JobSpec(input_dir="base/meta", output_dir="out"))
    return sinks.write_converted(rows, manifest.select("texture_id", "output_path"), folder)


# -- projections and planning ------------------------------------------------


def path_parts(spark, d):
    path = F.col("path")
    return fx.assets(spark, d).select(
        "texture_id",
        paths.stem(path).alias("stem"),
        paths.ext(path).alias("ext"),
        paths.entry_ext(path).alias("entry_ext"),
        paths.base_name(path).alias("base_name"),
        paths.parent(path).alias("parent"),
    )


def classify_format(spark, d):
    return ops.classify(fx.assets(spark, d)).select(
        "texture_id", "file_format", formats.default_ext(F.col("file_format")).alias("default_ext")
    )


def guess_kind(spark, d):
    kind = kinds.guess_kind(paths.stem(F.col("path")), F.col("pixel_format"))
    return fx.assets(spark, d).select("texture_id", kind.alias("kind"))


def channel_kinds(spark, d):
    names = F.array_join(kinds.channel_kinds(paths.stem(F.col("path"))), ",")
    return fx.assets(spark, d).select("texture_id", names.alias("channel_kinds"))


def _requested(key):
    return fx.pick([*rules.KIND_OF_ARGUMENT, "shiny"], key % 20)


def parse_kind(spark, d):
    named = fx.assets(spark, d).select("texture_id", _requested(F.col("texture_id")).alias("argument"))
    kind = kinds.parse_kind(F.col("argument"))
    return named.select("texture_id", "argument", kind.alias("kind"), kind.isNull().alias("rejected"))


def apply_kind(spark, d):
    key = F.col("texture_id")
    override = F.when(key % 3 == 0, kinds.parse_kind(_requested(key)))
    tagged = ops.apply_kind(fx.assets(spark, d), override)
    return tagged.select("texture_id", "kind", F.array_join("channel_kinds", ",").alias("channel_kinds"))


def display_names(spark, d):
    a = ops.classify(fx.assets(spark, d)).withColumn("kind", kinds.parse_kind(_requested(F.col("texture_id"))))
    key = F.col("texture_id")
    return a.select(
        "texture_id",
        kinds.display_name(F.col("file_format"), "file_format").alias("format_name"),
        kinds.display_name(F.col("pixel_format"), "pixel_format").alias("pixel_name"),
        kinds.display_name(fx.pick(fx.TYPES, key % 3), "type").alias("type_name"),
        kinds.display_name(F.col("kind"), "kind").alias("kind_name"),
        kinds.display_name((key % 8).cast("int"), "blp_encoding").alias("blp_name"),
        kinds.display_name((key % 10).cast("int"), "dds_format").alias("dds_name"),
    )


def plan_output(spark, d):
    keep = planning.output_path(F.col("path"), JobSpec(input_dir="base/meta", output_dir="out/"))
    flat = planning.output_path(F.col("path"), JobSpec(input_dir="base/meta", output_dir="out", keep_layout=False, output_format=4))
    return fx.assets(spark, d).select("texture_id", keep.alias("kept_layout"), flat.alias("flat"))


def output_collisions(spark, d):
    spec = JobSpec(input_dir="base/meta", output_dir="out", keep_layout=False)
    flat = F.concat(paths.parent(F.col("path")), F.lit("/"), F.col("texture_id") % 50, F.lit(".tex"))
    planned = planning.plan_output(fx.unique_assets(spark, d).withColumn("name", flat), spec)
    crowded = planned.withColumn("output_path", F.concat(F.lit("out/"), F.element_at(F.split("name", "/"), -1)))
    return planning.mark_collisions(crowded).select("texture_id", "output_path", "is_duplicate")


def format_predicates(spark, d):
    tagged = ops.apply_kind(fx.assets(spark, d))
    return tagged.select(
        "texture_id",
        kinds.is_channel_map(F.col("kind")).alias("is_channel_map"),
        formats.is_bcn(F.col("pixel_format")).alias("is_bcn"),
        formats.working_format(F.col("pixel_format")).alias("working_format"),
    )


def clamp_options(spark, d):
    key = F.col("texture_id")
    tagged = ops.apply_kind(fx.assets(spark, d))
    return tagged.select(
        "texture_id",
        formats.clamp_blp((key % 2).cast("int"), (key % 9).cast("int")).alias("blp_encoding"),
        formats.clamp_dds(F.col("kind"), (key % 10).cast("int")).alias("dds_format"),
    )


def plan_blp(spark, d):
    planned = planning.plan_blp(fx.assets(spark, d), BLP_SPEC)
    jpeg = planning.plan_blp(fx.assets(spark, d), JobSpec(output_format=0, blp_encoding=3, jpeg_quality=90))
    columns = ["texture_id", "blp_version", "blp_encoding", "target_format", "needs_convert", "dither", "jpeg_quality"]
    return planned.select(*columns).unionAll(jpeg.select(*columns))


def plan_dds(spark, d):
    planned = planning.plan_dds(ops.apply_kind(fx.assets(spark, d)), DDS_SPEC)
    return planned.select(
        "texture_id", "dds_format", "invert_g", "swap_ra", "intermediate_format", "target_format", "needs_convert"
    )


def _requests(spark, d):
    return _with_options(fx.assets(spark, d))


def _with_options(assets, *kept):
    key = F.col("texture_id")

    def some(values, step):
        return fx.pick(values, fx.div(key, step) % len(values))

    none = None
    outputs = F.when(key % 3 == 0, F.concat(F.lit("out/"), key, some([".blp", ".dds", ".JPG", ".tga", ".gif"], 3)))
    return assets.select(
        "texture_id",
        *kept,
        F.col("path").alias("input"),
        outputs.alias("output"),
        some([none, "1", "2", "3", none, none], 5).alias("blp_type"),
        some([none, "JPEG", "paletted", none, "bc2", none, "bc9", "true_color"], 7).alias("blp_compression"),
        some([none, "bc3n", "BC7", "bc6", none, "bc4", "bc8"], 11).alias("dds_format"),
        some([none, none, "90", "0", " 55x", none], 13).alias("jpeg_quality"),
        some([none, "Normal", none, "multikind", "shiny", none, none], 17).alias("texture_kind"),
        some([none, "x2", none, "X4", none, none, "x8"], 19).alias("downscale"),
        some([none, "maximum", none, "custom", none, "some"], 23).alias("generate_mipmaps"),
        some([none, "3", "0", "99", "abc"], 29).alias("mipmap_count"),
        some([none, "", "0.5", "7", none], 31).alias("blp_dither"),
        (fx.div(key, 2) % 4 == 1).alias("dds_invert_y"),
        "pixel_format",
        "width",
        "height",
        "mip_count",
    )


def resolve_options(spark, d):
    return jobs.resolve_options(_requests(spark, d)).drop("input", "pixel_format", "width", "height", "mip_count")


def convert_jobs(spark, d):
    return jobs.convert_jobs(_requests(spark, d), _scale()).drop("input")


def _scale():
    return fx.pick([1, 1, 2, 4], fx.div(F.col("texture_id"), 37) % 4)


def _pixel_jobs(spark, d):
    """Two requests for each stored texture; they often begin with the same steps."""
    key = F.col("texture_id")
    assets = fx.pixel_assets(spark, d).withColumns({"mip_count": fx.stored_levels(key), "vec": key, "j": F.explode(F.array(F.lit(0), F.lit(1)))})
    asked = _with_options(assets.withColumn("texture_id", F.col("vec") * 2 + F.col("j")), "vec")
    plan = jobs.plan_jobs(asked, _scale())
    return plan.withColumnsRenamed({"texture_id": "request_id", "vec": "texture_id"})


def convert_jobs_pixels(spark, d):
    plan = stage(_pixel_jobs(spark, d), "jobs")
    return jobs.convert_job_pixels(plan, fx.stored_pixels(spark, d)).select("request_id", *PIXEL, "kind", "target_format")


def convert_jobs_options(spark, d):
    """What the writer of each request is told."""
    plan = jobs.plan_jobs(_requests(spark, d), _scale()).filter("success")
    return plan.select("texture_id", F.array_join("channel_kinds", ",").alias("channel_kinds"), "halve", "scale", "anew", "dither", "dither_strength", "jpeg_quality")


def load_attempts(spark, d):
    found = _companions(spark, d).withColumn("is_d4", F.col("texture_id") % 5 != 0)
    return companions.load_attempts(found).select("texture_id", "load_as", "payload", "paylow")


def effective_mips(spark, d):
    w, h = F.col("width"), F.col("height")
    return fx.assets(spark, d).select(
        "texture_id",
        formats.effective_mips(0, 4, w, h).alias("kept"),
        formats.effective_mips(MAXIMUM, 4, w, h).alias("full"),
        formats.effective_mips(CUSTOM, F.col("mip_count") * 3 - 3, w, h).alias("custom"),
    )


def mip_geometry(spark, d):
    return ops.mip_geometry(fx.assets(spark, d))


def can_downscale(spark, d):
    fits = {f"x{2 ** k}": formats.can_downscale(F.col("width"), F.col("height"), k) for k in (1, 2)}
    return fx.assets(spark, d).select("texture_id", *[c.alias(n) for n, c in fits.items()])


def upscale_geometry(spark, d):
    return ops.upscale_geometry(fx.assets(spark, d), 3).select("texture_id", "width", "height", "mip_count")


def _companions(spark, d):
    tex = fx.assets(spark, d).filter(paths.ext(F.col("path")) == ".tex")
    return companions.resolve_companions(tex, fx.listing(spark, d))


def review_flags(spark, d):
    key = F.col("texture_id")
    found = ops.classify(_companions(spark, d)).withColumns(
        {
            "is_d4": key % 5 != 0,
            "issues": F.when(key % 2 == 0, F.array(F.lit("bad"))).otherwise(F.array().cast("array<string>")),
            "pixel_format": F.when(key % 3 == 0, "BC3").otherwise(F.col("pixel_format")),
        }
    )
    return ops.review_flags(ops.apply_kind(found)).select("texture_id", "needs_bc3n", "needs_payload")


def search(spark, d):
    return ops.search(fx.assets(spark, d), "BRAND_1").select("texture_id", "path")


def replace_meta(spark, d):
    path = F.when(F.col("texture_id") % 4 == 0, F.replace("path", F.lit("meta"), F.lit("m"))).otherwise(F.col("path"))
    return fx.assets(spark, d).select("texture_id", paths.replace_meta(path, "payload").alias("payload"))


# -- joins -------------------------------------------------------------------


def resolve_companions(spark, d):
    return _companions(spark, d).select("texture_id", "payload", "paylow", "companion")


def _triplets(spark, d):
    index = packed.last_writer(packed.packed_offsets(fx.packed(spark, d)))
    return companions.resolve_triplet(archive.toc_entries(fx.toc(spark, d)), fx.archive_blobs(spark, d), index)


def resolve_triplet(spark, d):
    return _triplets(spark, d)


def _ranged_index(spark, d):
    """Index of real packed files, each known by the number in its name."""
    return stage(ranged.ranged_index(files.scan_assets(spark, fx.write_packed(spark, d))), "index")


def ranged_slices(spark, d):
    """Packed files to index to slices by byte ranges."""
    cut = ranged.ranged_slices(_ranged_index(spark, d), fx.HEADER_MAGIC, F.lit(77))
    return cut.select("sno", F.hex("data").alias("data"))


def triplet_bytes(spark, d):
    """Index to slice to the bytes of the three parts."""
    index = _ranged_index(spark, d)
    found = stage(companions.resolve_triplet(archive.toc_entries(fx.toc(spark, d)), fx.archive_blobs(spark, d), packed.last_writer(index)), "triplets")
    blobs = fx.blob_bytes(fx.archive_blobs(spark, d))
    wanted = index.join(found.filter("meta_source = 'packed'").select("sno"), "sno", "left_semi")
    slices = ranged.ranged_slices(wanted, fx.HEADER_MAGIC, F.lit(77))
    rows = companions.attach_bytes(found, blobs, slices, fx.HEADER_MAGIC)
    return rows.select("name", "sno", *[F.hex(c).alias(c) for c in ("data", "payload_data", "paylow_data")])


def packed_slices(spark, d):
    """Index to slice: the winning entry of each id behind its header."""
    blobs = fx.packed_blobs(spark, d).select("f", "blob")
    winners = stage(packed.last_writer(packed.packed_index(blobs)), "winners")
    cut = archive.packed_slices(blobs, winners, fx.HEADER_MAGIC, F.lit(77))
    return cut.select("sno", F.hex("data").alias("data"))


def unreadable_files(spark, d):
    present = fx.listing(spark, d).select("path", F.length("path").cast("long").alias("length"))
    kept = present.filter(F.col("length") % 7 != 0).withColumn("length", F.when(F.col("length") % 5 == 0, 0).otherwise(F.col("length")))
    return companions.unreadable(fx.listing(spark, d), kept)


def unavailable_assets(spark, d):
    gone = companions.unavailable(archive.toc_entries(fx.toc(spark, d)), _triplets(spark, d))
    return gone.select("sno", "message")


def group_format_hash(spark, d):
    slices = packed.last_writer(packed.packed_offsets(fx.packed(spark, d))).select("sno", "size")
    return companions.attach_hash(slices, fx.group_hashes(spark, d))


def carry_metadata(spark, d):
    source = ops.apply_kind(fx.assets(spark, d)).withColumn("srgb", F.col("texture_id") % 2 == 0)
    derived = ops.upscale_geometry(fx.assets(spark, d), 2).select("texture_id", "width", "height")
    joined = ops.carry_metadata(derived, source)
    return joined.withColumn("channel_kinds", F.array_join("channel_kinds", ","))


# -- pixels ------------------------------------------------------------------


def _on_pixels(op):
    def query(spark, d):
        return op(fx.plain_pixels(spark, d)).select(*PIXEL)

    return query


def _on_tagged(op):
    def query(spark, d):
        return op(fx.pixels(spark, d)).select(*PIXEL)

    return query


def quantize_u8(spark, d):
    return fx.pixels(spark, d).select(
        "texture_id", "x", "y", colour.to_u8((F.col("r") * 1.5 - F.col("g")) / 255).alias("value")
    )


def grey_reduce(spark, d):
    return fx.pixels(spark, d).select("texture_id", "x", "y", colour.grey(F.col("r"), F.col("g"), F.col("b")).alias("grey"))


def mip_chain(spark, d):
    return mips.mip_chain(fx.plain_pixels(spark, d)).select(*PIXEL)


def mip_pyramid(spark, d):
    """:func:`mip_chain` from tiles of the same pixels."""
    return tiles.pixels_of(tiles.tile_pyramid(tiles.to_tiles(fx.plain_pixels(spark, d)))).select(*PIXEL)


def mip_pyramid_normal(spark, d):
    rows = fx.pixels(spark, d)
    kinds = rows.filter("x = 0 AND y = 0").select("texture_id", "kind")
    return tiles.pixels_of(tiles.tile_pyramid(tiles.to_tiles(rows), 4, kinds)).select(*PIXEL, "kind")


def mip_chain_normal(spark, d):
    rows = fx.pixels(spark, d).drop("pixel_format", "channel_kinds")
    return mips.mip_chain(rows, 4).select(*PIXEL, "kind")


def select_mip(spark, d):
    return mips.select_mip(mips.mip_chain(fx.plain_pixels(spark, d), 5), 4).select(*PIXEL)


def select_stored_mip(spark, d):
    """The level count is stored with the texture: nothing is joined."""
    rows = fx.stored_pixels(spark, d).withColumn("levels", fx.stored_levels(F.col("texture_id")))
    return mips.select_mip(rows, 2, "levels").select(*PIXEL)


def working_format(spark, d):
    seen = "seen_format"
    rows = steps.with_working_format(
        fx.pixels(spark, d), lambda df: px.invert(df.withColumn(seen, F.col("pixel_format")), "g")
    )
    return rows.select(*PIXEL, "pixel_format", seen)


def transform_steps(spark, d):
    """Rows of each texture, with as many levels as the steps leave it."""
    _, _, rows = steps.run_steps(_levelled(spark, d), fx.plain_pixels(spark, d), TWO_STEPS)
    return rows.select(*PIXEL)


def _levelled(spark, d):
    return fx.pixel_assets(spark, d).withColumn("mip_count", (F.col("texture_id") % 4 + 1).cast("int"))


def transform_upscaled(spark, d):
    _, _, rows = steps.run_steps(_levelled(spark, d), fx.plain_pixels(spark, d), (Step("upscale", scale=2),))
    return rows.select(*PIXEL)


def transform_downscaled(spark, d):
    _, _, rows = steps.run_steps(_levelled(spark, d), fx.plain_pixels(spark, d), (Step("downscale"),))
    return rows.select(*PIXEL)


def transform_status(spark, d):
    done, failed, _ = steps.run_steps(fx.assets(spark, d), fx.plain_pixels(spark, d), TWO_STEPS)
    columns = ["texture_id", "width", "height", "mip_count"]
    none = F.lit(None)
    ok = done.select(*columns, none.cast("int").alias("failed_step"), none.cast("string").alias("message"))
    return ok.unionByName(failed.select(*columns, "failed_step", "message"))


# -- conversion jobs ---------------------------------------------------------


def batch_plan(spark, d):
    planned = planning.batch_plan(fx.assets(spark, d), PLAN_SPEC)
    return planned.withColumn("channel_kinds", F.array_join("channel_kinds", ","))


def _convert_spec(spark):
    return JobSpec(
        input_dir="base/meta",
        output_dir=new_folder(spark, "converted"),
        dds_mode=1,
        dds_format_normal=8,
        dds_invert_y_normal=True,
        generate_mipmaps=True,
        mipmap_mode=MAXIMUM,
        steps=(Step("downscale"),),
    )


def convert(spark, d):
    spec = _convert_spec(spark)
    conversion.convert(fx.pixel_assets(spark, d), fx.plain_pixels(spark, d), spec)
    return spark.read.parquet(f"{spec.output_dir}/pixels").select(*PIXEL, "kind", "target_format")


def convert_resumed(spark, d):
    """A batch that stops after two of five shares and is run again: outputs are those of one run."""
    spec, owners, rows = _convert_spec(spark), fx.pixel_assets(spark, d), fx.plain_pixels(spark, d)
    resume.convert_shares(owners, rows, spec, shares=5, at_most=2)
    resume.convert_shares(owners, rows, spec, shares=5)
    return resume.converted_pixels(spark, spec.output_dir).select(*PIXEL, "kind", "target_format")


def convert_replaced(spark, d):
    """Outputs of an earlier batch with other options: those of even ids may be replaced, the others are kept."""
    spec, owners = _convert_spec(spark), fx.pixel_assets(spark, d)
    rows, earlier = fx.plain_pixels(spark, d), replace(spec, dds_mode=0)
    resume.convert_shares(owners, rows, earlier, shares=2)
    resume.convert_shares(owners, rows, spec, shares=2, replace=F.col("texture_id") % 2 == 0)
    return resume.converted_pixels(spark, spec.output_dir).select(*PIXEL, "kind", "target_format")


def convert_files_resumed(spark, d):
    """Image files converted in two runs; the summary is the last snapshot of the second."""
    spec = JobSpec(input_dir=fx.write_bitmaps(spark, d), output_dir=new_folder(spark, "converted"))
    resume.convert_files_resumable(spark, spec, shares=3, at_most=1)
    return resume.convert_files_resumable(spark, spec, shares=3)


def convert_keep_mips(spark, d):
    """No steps and no new levels: stored levels pass, however wrong a stated height is."""
    spec = JobSpec(
        input_dir="base/meta",
        output_dir=new_folder(spark, "converted"),
        dds_mode=1,
        dds_format_normal=8,
        dds_invert_y_normal=True,
    )
    key = F.col("texture_id")
    stated = F.when(key % 3 == 0, F.lit(None)).when(key % 3 == 1, 1).otherwise(F.col("height"))
    owners = fx.pixel_assets(spark, d).withColumns({"mip_count": fx.stored_levels(key), "height": stated.cast("int")})
    conversion.convert(owners, fx.stored_pixels(spark, d), spec)
    return spark.read.parquet(f"{spec.output_dir}/pixels").select(*PIXEL, "kind", "target_format")


def convert_collisions(spark, d):
    """Outputs shared by many inputs, some of which failed, some with equal paths."""
    key = F.col("texture_id")
    crowded = F.concat(F.lit("base/meta/"), key % 25, pick_name(key), F.lit(".png"))
    lost = F.when(key % 4 == 0, F.concat(F.lit("Failed to load: "), key))
    owners = fx.pixel_assets(spark, d).withColumns({"path": crowded, "load_error": lost})
    plan = conversion.settled_plan(owners, JobSpec(input_dir="base/meta", output_dir="out", keep_layout=False))
    return plan.select("texture_id", "path", "output_path", "success", "message")


def pick_name(key):
    """A few names per folder, so that flat outputs and whole paths repeat."""
    return fx.pick(["/a", "/b", "/a"], fx.div(key, 25) % 3)


def convert_files(spark, d):
    spec = JobSpec(input_dir=fx.write_bitmaps(spark, d), output_dir=new_folder(spark, "converted"))
    return conversion.convert_files(spark, spec)


def asset_details(spark, d):
    key = F.col("texture_id")
    tagged = ops.apply_kind(ops.classify(fx.assets(spark, d))).withColumns(
        {
            "type": fx.pick(fx.TYPES, key % 3),
            "depth": (key % 3).cast("int") + 1,
            "layers": F.when(key % 3 == 2, 6).otherwise(1),
            "srgb": key % 2 == 0,
        }
    )
    return ops.asset_details(tagged)


# -- summaries ---------------------------------------------------------------


def batch_summary(spark, d):
    planned = planning.batch_plan(fx.assets(spark, d), PLAN_SPEC)
    return report.batch_summary(planned.withColumn("success", F.when(F.col("texture_id") % 97 != 0, F.col("success"))))


def archive_summary(spark, d):
    toc = archive.toc_entries(fx.toc(spark, d))
    return report.archive_summary(fx.listing(spark, d), toc, archive.is_texture(F.col("path")))


def archive_summary_empty(spark, d):
    """The kind of archive with a table of contents, but no entry of the group in it."""
    toc = archive.toc_entries(fx.toc(spark, d), "Absent")
    return report.archive_summary(fx.listing(spark, d), toc, archive.is_texture(F.col("path")))


def tree_nodes(spark, d):
    return report.tree_nodes(archive.texture_entries(fx.listing(spark, d)), archive.toc_entries(fx.toc(spark, d)), "r")


def tree_all(spark, d):
    return report.tree_nodes(archive.texture_entries(fx.listing(spark, d)), archive.toc_entries(fx.toc(spark, d)), "")


def recent_items(spark, d):
    return _recent_shown(report.recent_items(fx.opens(spark, d)))


def _recent_shown(rows):
    return rows.select("user_id", "item", "position", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


def recent_items_merged(spark, d):
    """The table after three updates, each with a third of all events in no order."""
    folder, events = new_folder(spark, "recent"), fx.opens(spark, d)
    for part in range(3):
        recent.update_recent(events.filter(F.pmod(F.xxhash64("item", "ts"), F.lit(3)) == part), folder)
    return _recent_shown(recent.read_recent(spark, folder))


def recent_items_streamed(spark, d):
    """The table kept by a stream over files of events, two at a time."""
    arriving, folder = new_folder(spark, "arriving"), new_folder(spark, "recent")
    events = fx.opens(spark, d)
    events.repartition(6).write.parquet(arriving)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(arriving)
    recent.keep_recent(stream, folder, new_folder(spark, "stream-checkpoint"), availableNow=True).awaitTermination()
    return _recent_shown(recent.read_recent(spark, folder))


def union_catalog(spark, d):
    return report.union_catalog(archive.texture_entries(fx.listing(spark, d)), archive.toc_entries(fx.toc(spark, d)))


QUERIES = {
    f.__name__: f
    for f in (
        classify_count, scan_assets, load_images, load_outcomes, filter_formats, supported_listing, toc_textures,
        packed_files, packed_index, packed_offsets, last_writer, split_rejects, issue_report, extract_slice,
        strip_header, write_converted, path_parts, classify_format, guess_kind, channel_kinds, parse_kind, apply_kind,
        display_names, plan_output, output_collisions, format_predicates, clamp_options, plan_blp, plan_dds,
        resolve_options, convert_jobs, effective_mips, mip_geometry, can_downscale, upscale_geometry, review_flags,
        search, replace_meta, resolve_companions, resolve_triplet, triplet_bytes, packed_slices, unreadable_files,
        unavailable_assets, group_format_hash,
        carry_metadata, quantize_u8, grey_reduce, mip_chain, mip_chain_normal, select_mip, working_format,
        transform_steps, transform_upscaled, transform_downscaled, transform_status, batch_plan, convert, convert_keep_mips, convert_collisions, convert_files,
        asset_details, batch_summary, archive_summary, archive_summary_empty, tree_nodes, tree_all, recent_items,
        union_catalog, select_stored_mip, convert_jobs_pixels, convert_jobs_options, load_attempts, scan_all, supported_listing_ranked, ranged_slices, mip_pyramid, mip_pyramid_normal,
        convert_resumed, convert_replaced, convert_files_resumed, recent_items_merged, recent_items_streamed,
    )
} | {
    "swap_channels": _on_pixels(lambda df: px.swap(df, "r", "a")),
    "invert_channel": _on_pixels(lambda df: px.invert(df, "g")),
    "bc3n_pack": _on_pixels(lambda df: px.bc3n_pack(df, True)),
    "bc3n_pack_plain": _on_pixels(px.bc3n_pack),
    "bc3n_unpack": _on_pixels(px.bc3n_unpack),
    "channel_filter_one": _on_pixels(lambda df: px.channel_filter(df, r=False, b=False, a=False)),
    "channel_filter_some": _on_pixels(lambda df: px.channel_filter(df, g=False, a=False)),
    "expand_display": _on_tagged(px.expand_display),
    "expand_normal": _on_tagged(px.expand_normal),
    "display_texture": _on_tagged(px.display_texture),
    "fill_unused": _on_tagged(lambda df: px.fill_unused(df, 0.5)),
    "fill_unused_each": _on_tagged(lambda df: px.fill_unused(df, {"r": 0.1, "g": 0.2, "b": 0.3, "a": 0.75})),
    "upscale_x2": _on_tagged(lambda df: px.upscale(df, 2)),
    "upscale_x3_alpha": _on_pixels(lambda df: px.upscale(df, 3, alpha=True)),
    "downscale_x2": _on_pixels(lambda df: mips.downscale(df, 1)),
    "downscale_x4": _on_pixels(lambda df: mips.downscale(df, 2)),
}
