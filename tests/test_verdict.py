"""Cases beyond the derived views: nulls, wrong sizes, equal paths, plans."""

import pytest
from pyspark.sql import functions as F
from texelyard.operators import assets as ops
from texelyard.operators import companions, mips, pixels
from texelyard.operators.running import blocked_running_sum
from texelyard.plans import convert as conversion
from texelyard.session import new_folder
from texelyard.sources import files, sinks
from texelyard.spec import JobSpec

PIXELS = "texture_id long, width int, height int, mip int, x int, y int, r int, g int, b int, a int"


def exchanges(df):
    """Hash exchanges of a plan with automatic broadcasts off, each counted once."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange")


@pytest.fixture
def no_broadcast(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_every_load_is_taken_or_rejected(spark):
    flags = [True, False, None]
    rows = [
        (k, fmt, has, issues, buffered, d4)
        for k, (fmt, has, issues, buffered, d4) in enumerate(
            (fmt, has, issues, buffered, d4)
            for fmt in ("TEX", "PNG", "Unknown", None) for has in flags for issues in ([], ["x"], None) for buffered in flags for d4 in flags
        )
    ]
    df = spark.createDataFrame(rows, "id int, file_format string, has_result boolean, issues array<string>, from_buffer boolean, is_d4 boolean")
    ok, bad = files.split_rejects(df)
    good, lost = {r.id for r in ok.collect()}, {r.id for r in bad.collect()}
    assert good | lost == {r[0] for r in rows} and not good & lost
    assert all(rows[k][2] for k in good)
    assert bad.filter("issues IS NULL").count() == 0


def test_metadata_of_a_missing_source_is_null(spark):
    derived = spark.createDataFrame([(1,), (2,), (None,)], "texture_id long")
    source = spark.createDataFrame([(1, "Normal", True, ["a"])], "texture_id long, kind string, srgb boolean, channel_kinds array<string>")
    rows = {r.texture_id: r.kind for r in ops.carry_metadata(derived, source).collect()}
    assert rows == {1: "Normal", 2: None, None: None}


def test_very_wide_textures_keep_their_size(spark):
    wide = spark.createDataFrame([(1, 1 << 22, 1, 0, (1 << 22) - 1, 0, 9, 9, 9, 9)], PIXELS)
    rows = {r.mip: r for r in mips.mip_chain(wide, 3).collect()}
    assert [(rows[k].width, rows[k].height, rows[k].x) for k in range(3)] == [(1 << 22, 1, ((1 << 22) - 1) >> k) for k in range(3)]
    tall = spark.createDataFrame([(1, 2, 2147483647, 0, 0, 2147483646, 9, 9, 9, 9)], PIXELS)
    assert mips.downscale(tall, 1).first()["height"] == 2147483647 >> 1


def test_no_pixel_is_lost_to_a_stated_height(spark):
    rows = spark.createDataFrame([(t, 1, 9000, 0, 0, y, 1, 2, 3, 4) for t in (1, 2) for y in range(0, 9000, 30)], PIXELS)
    textures = spark.createDataFrame([(1, "a"), (2, "b")], "texture_id long, tag string")
    joined = pixels.with_texture(rows, textures)
    assert joined.count() == rows.count() and joined.columns == [*rows.columns, "tag"]


def test_collisions_are_won_by_what_can_be_written(spark):
    owners = spark.createDataFrame(
        [(1, "in/a/x.png", "broken"), (2, "in/b/x.png", None), (3, "in/b/x.png", None), (4, "in/c/y.png", None)],
        "texture_id long, path string, load_error string",
    ).withColumns({"pixel_format": F.lit("RGBA8"), "width": F.lit(4), "height": F.lit(4), "mip_count": F.lit(1)})
    plan = conversion.settled_plan(owners, JobSpec(input_dir="in", output_dir="out", keep_layout=False))
    assert {r.texture_id: (r.success, r.message) for r in plan.collect()} == {
        1: (False, "broken"), 2: (True, None), 3: (False, conversion.DUPLICATE), 4: (True, None),
    }


def test_existing_output_is_refused_before_anything_is_written(spark):
    folder = new_folder(spark, "out")
    rows = spark.createDataFrame([(1, 1, 1, 0, 0, 0, 1, 2, 3, 4, "BC7")], PIXELS + ", target_format string")
    manifest = spark.createDataFrame([(1, "o")], "texture_id long, output_path string")
    sinks.write_converted(rows, manifest, folder)
    with pytest.raises(FileExistsError):
        sinks.write_converted(rows, manifest, folder)
    sinks.write_converted(rows, manifest, folder, overwrite=True)
    broken = rows.withColumn("r", F.raise_error(F.lit("lost")).cast("int"))
    other = new_folder(spark, "out")
    with pytest.raises(Exception, match="lost"):
        sinks.write_converted(broken, manifest, other)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{other}/manifest")


def test_only_exact_archive_names_are_ids(spark):
    names = ["base:payload\\12", "base:payload\\012", "base:payload\\ 13", "base:payload\\+14", "base:meta\\12", "other:meta\\12", "base:payload\\99999999999"]
    blobs = spark.createDataFrame([(n, 5) for n in names], "path string, length long")
    packed = spark.createDataFrame([], "sno int, f long, start long, size int")
    rows = companions.archive_refs(blobs, packed).collect()
    assert [(r.sno, r.payload, r.id_meta) for r in rows] == [(12, names[0], names[4])]


def test_running_sum_moves_rows_once(spark, no_broadcast):
    rows = spark.createDataFrame([(g, o, 1, "wide") for g in (1, 2, None) for o in (0, 1, 5, None)], "g long, o long, v int, body string")
    summed = blocked_running_sum(rows, "g", F.shiftright("o", 1), ["o"], F.col("v"), "before", "total")
    # Whole rows go by (group, block) once; partial sums go to their block, its group and back.
    assert exchanges(summed) == 4
    got = {(r.g, r.o): (r.before, r.total) for r in summed.collect()}
    assert got == {(g, o): (k, 4) for g in (1, 2, None) for k, o in enumerate((None, 0, 1, 5))}


def test_stored_level_count_needs_no_join(spark, no_broadcast):
    rows = spark.createDataFrame([(1, 4, 4, m, 0, 0, m, 0, 0, 0, 2) for m in range(2)], PIXELS + ", levels int")
    assert exchanges(mips.select_mip(rows, 3, "levels")) == 0
    assert [r.mip for r in mips.select_mip(rows, 3, "levels").collect()] == [1]


def test_archive_bytes_are_exchanged_twice(spark, no_broadcast):
    found = spark.createDataFrame([("a.tex", 1, "id", "base:meta\\1", "base:payload\\1", None)], "name string, sno int, meta_source string, meta string, payload string, paylow string")
    blobs = spark.createDataFrame([("base:meta\\1", bytearray(b"M")), ("base:payload\\1", bytearray(b"P")), ("other", bytearray(b"X"))], "path string, data binary")
    slices = spark.createDataFrame([], "sno int, data binary")
    full = companions.attach_bytes(found, blobs, slices, 7)
    plan = full._jdf.queryExecution().optimizedPlan().toString()
    # Contents meet the wanted paths, then are grouped by id; the last join only adds the narrow triplets.
    assert plan.count("Join Inner") == 2
    assert [(r.name, bytes(r.data), bytes(r.payload_data), r.paylow_data) for r in full.collect()] == [("a.tex", b"M", b"P", None)]


def test_missing_and_empty_files_are_unreadable(spark):
    listing = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    blobs = spark.createDataFrame([("a", 3), ("b", 0)], "path string, length long")
    rows = companions.unreadable(listing, blobs).collect()
    assert {r.path: r.message for r in rows} == {"b": "Failed to read: b", "c": "Failed to read: c"}


def test_unused_channels_take_their_own_default(spark):
    rows = spark.createDataFrame([(1, 1, 1, 0, 0, 0, 9, 9, 9, 9, ["Unused", "AO", "Unused", None])], PIXELS + ", channel_kinds array<string>")
    filled = pixels.fill_unused(rows, {"r": 1.0, "b": 0.5}).first()
    assert (filled.r, filled.g, filled.b, filled.a) == (255, 9, 128, 9)
