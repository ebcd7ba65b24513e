"""Conversion requests as a table: defaults, precedence and errors."""

import pytest

from texelyard.operators import companions
from texelyard.plans import jobs, planning
from texelyard.spec import JobSpec

SCHEMA = (
    "input string, output string, blp_type string, blp_compression string, dds_format string, jpeg_quality string, "
    "texture_kind string, downscale string, generate_mipmaps string, mipmap_count string, blp_dither string, "
    "dds_invert_y boolean, pixel_format string, width int, height int, mip_count int"
)
BASE = {"input": "a/t_nrm.png", "pixel_format": "BC3", "width": 16, "height": 8, "mip_count": 3}


def resolve(spark, **options):
    names = [field.split()[0] for field in SCHEMA.split(", ")]
    row = BASE | options
    return spark.createDataFrame([tuple(row.get(n) for n in names)], SCHEMA)


@pytest.mark.parametrize(
    "options, want",
    [
        ({}, {"output_path": "a/t_nrm.jpg", "output_format": "JPEG", "jpeg_quality": 75, "dither": False, "dither_strength": 0.8}),
        ({"input": "a/t.dds"}, {"output_path": "a/t.blp", "output_format": "BLP", "blp_version": 1, "blp_encoding": 0}),
        ({"input": "a/T.TEX"}, {"output_path": "a/T.dds", "dds_index": None}),
        ({"output": "o.blp", "jpeg_quality": "90"}, {"blp_encoding": 3, "jpeg_quality": 90}),
        ({"output": "o.blp", "jpeg_quality": "90", "blp_compression": "BC1"}, {"blp_encoding": 4}),
        ({"output": "o.dds", "jpeg_quality": "90"}, {"blp_encoding": 0}),
        ({"output": "o.blp", "blp_compression": "paletted"}, {"dither": True, "dither_strength": 0.8}),
        ({"output": "o.dds", "blp_compression": "paletted"}, {"dither": False}),
        ({"blp_dither": "-3"}, {"dither": True, "dither_strength": 0.0}),
        ({"blp_dither": ".25x"}, {"dither": True, "dither_strength": 0.25}),
        ({"blp_dither": "9e3"}, {"dither_strength": 1.0}),
        ({"blp_dither": ""}, {"dither": True, "dither_strength": 0.8}),
        ({"generate_mipmaps": "custom"}, {"mipmap_mode": 2, "mipmap_count": 1}),
        ({"generate_mipmaps": "custom", "mipmap_count": "-4"}, {"mipmap_mode": 2, "mipmap_count": 1}),
        ({"generate_mipmaps": "Maximum", "mipmap_count": "7"}, {"mipmap_mode": 1, "mipmap_count": 1}),
        ({"downscale": "X4"}, {"downscale_levels": 2}),
        ({"texture_kind": "AO"}, {"explicit_kind": "AmbientOcclusion"}),
        ({"input": "a/.png"}, {"error": "input has no known format: "}),
        ({"input": "a/x.TXT"}, {"error": "input has no known format: .TXT"}),
        ({"output": "o.gif", "blp_type": "9"}, {"error": "output has no known format: .gif"}),
        ({"blp_type": "3", "dds_format": "bc9"}, {"error": "blp_type '3' is not 1 or 2"}),
        ({"jpeg_quality": "abc"}, {"error": "jpeg_quality 'abc' is not from 1 to 100"}),
        ({"jpeg_quality": "101"}, {"error": "jpeg_quality '101' is not from 1 to 100"}),
        ({"jpeg_quality": " 12abc"}, {"jpeg_quality": 12, "error": None}),
        ({"downscale": "x8"}, {"error": "downscale 'x8' is not one of x2 x4"}),
    ],
)
def test_resolve_options(spark, options, want):
    row = jobs.resolve_options(resolve(spark, **options)).first().asDict()
    assert {c: row[c] for c in want} == want


@pytest.mark.parametrize(
    "options, want",
    [
        ({"output": "o.dds", "dds_format": "bc3n", "dds_invert_y": True},
         {"kind": "Normal", "intermediate_format": "RGBA8", "target_format": "BC3", "swap_ra": True, "invert_g": True}),
        ({"output": "o.dds", "dds_invert_y": True}, {"intermediate_format": "RGBA8", "target_format": "RGBA8", "needs_convert": False}),
        ({"output": "o.dds"}, {"target_format": "BC3", "invert_g": False, "needs_convert": False, "out_mips": 3}),
        ({"output": "o.dds", "downscale": "x2"}, {"target_format": "RGBA8", "out_width": 8, "out_height": 4, "out_mips": 2}),
        ({"output": "o.png", "generate_mipmaps": "maximum"}, {"target_format": "RGBA8", "out_mips": 5}),
        ({"output": "o.blp", "blp_compression": "bc2", "blp_type": "1"},
         {"blp_container": "BLP1", "blp_code": "DXT", "target_format": "BC2", "needs_convert": True}),
        ({"output": "o.blp", "blp_compression": "jpeg"}, {"blp_container": "BLP1", "target_format": "RGBA8"}),
        ({"output": "o.xyz"}, {"success": False, "target_format": None, "out_mips": None}),
    ],
)
def test_convert_jobs(spark, options, want):
    row = jobs.convert_jobs(resolve(spark, **options)).first().asDict()
    assert {c: row[c] for c in want} == want


def test_lost_payloads_fail_the_batch(spark):
    meta = spark.createDataFrame(
        [(1, "meta/a.tex", "BC1", 8, 8, 1, True), (2, "meta/b.tex", "BC1", 8, 8, 1, True), (3, "meta/c.tex", "BC1", 8, 8, 1, False)],
        "texture_id bigint, path string, pixel_format string, width int, height int, mip_count int, is_d4 boolean",
    )
    listing = spark.createDataFrame([("paylow/a.tex",)], "path string")
    found = companions.companion_errors(companions.resolve_companions(meta, listing))
    got = {r.texture_id: (r.success, r.message) for r in planning.batch_plan(found, JobSpec()).collect()}
    assert got == {1: (True, None), 2: (False, "Failed to load D4 TEX: meta/b.tex"), 3: (True, None)}


def test_writer_options_follow_the_output_format(spark):
    assets = resolve(spark).selectExpr("1L AS texture_id", "input AS path", "pixel_format", "width", "height", "mip_count")
    blp = planning.batch_plan(assets, JobSpec(output_format=0, blp_encoding=2, blp_dither=True, jpeg_quality=60)).first()
    assert (blp.dither, blp.dither_strength, blp.jpeg_quality) == (True, 0.8, 60)
    jpeg = planning.batch_plan(assets, JobSpec(output_format=3, jpeg_progressive=True)).first()
    assert jpeg.jpeg_progressive and "dither" not in jpeg.asDict()
    assert "jpeg_quality" not in planning.batch_plan(assets, JobSpec(output_format=4)).columns


def test_a_plan_filtered_by_success_tests_a_column(spark):
    """The condition was put in terms of the requests: generated code beyond the 64 KB of a Java method, then interpreted."""
    plan = jobs.plan_jobs(resolve(spark, output="o.blp")).filter("success")
    told = plan._jdf.queryExecution().optimizedPlan().toString().splitlines()
    conditions = [line for line in told if "Filter" in line]
    assert conditions and all(len(line) < 200 for line in conditions)
    assert [r.output_path for r in plan.collect()] == ["o.blp"]
