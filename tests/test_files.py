"""Scans, image decoding, sinks and whole conversions over real files."""

import struct
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from texelyard import fixtures as fx
from texelyard.functions import paths
from texelyard.plans import convert as conversion
from texelyard.plans import planning
from texelyard.sources import files, listing, sinks
from texelyard.spec import JobSpec, Step


def png(rows, channels):
    """A PNG of rows of channel tuples: 1 grey, 3 colour or 4 with alpha."""
    colour = {1: 0, 3: 2, 4: 6}[channels]

    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    raw = b"".join(b"\0" + bytes(v for px in row for v in px) for row in rows)
    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("textures")
    (root / "sub" / "deep").mkdir(parents=True)
    colour = [[(x, y, x + y) for x in range(5)] for y in range(3)]
    (root / "a_diff.PNG").write_bytes(png(colour, 3))
    (root / "sub" / "b_nrm.png").write_bytes(png([[(9, 8, 7, x * 10) for x in range(4)] for _ in range(4)], 4))
    (root / "sub" / "deep" / "grey_rough.png").write_bytes(png([[(x,) for x in range(7)]], 1))
    (root / "sub" / "bad.png").write_bytes(b"no image")
    (root / "sub" / "x.dds").write_bytes(b"no image")
    (root / "note.txt").write_bytes(b"text")
    return root


def names(df):
    return {r[0] for r in df.select(paths.file_name(F.col("path"))).collect()}


def test_scan(spark, folder):
    assert names(files.scan_assets(spark, str(folder))) == {"a_diff.PNG", "b_nrm.png", "grey_rough.png", "bad.png", "x.dds", "note.txt"}
    assert names(files.scan_assets(spark, str(folder), enabled={"PNG"})) == {"a_diff.PNG", "b_nrm.png", "grey_rough.png", "bad.png"}
    assert names(files.scan_assets(spark, f"{folder}/", recursive=False)) == {"a_diff.PNG", "note.txt"}


def test_scan_reads_no_content(spark, folder):
    plan = files.scan_assets(spark, str(folder), enabled={"PNG"})._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "binaryFile" not in plan


@pytest.fixture
def odd_folder(tmp_path):
    for name in ("_a.png", ".b.png", "c.png", ".hidden/d.png", "_e/f/g.png", "plain/h.txt", "x" * 200 + ".png"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(png([[(1, 2, 3)]], 3))
    (tmp_path / "in" / "empty").mkdir()
    (tmp_path / "in" / "link.png").symlink_to(tmp_path / "in" / "c.png")
    (tmp_path / "in" / "broken.png").symlink_to(tmp_path / "gone")
    return tmp_path / "in"


def test_listing_of_an_odd_tree(spark, odd_folder):
    (odd_folder / "loop").symlink_to(odd_folder)
    rows = listing.list_tree(spark, str(odd_folder)).collect()
    root = f"file:{odd_folder}/"
    want = {"_a.png", ".b.png", "c.png", ".hidden/d.png", "_e/f/g.png", "plain/h.txt", "x" * 200 + ".png", "link.png"}
    assert {r.path.removeprefix(root) for r in rows} == want and len(rows) == len(want)
    assert all(r.length == (odd_folder / r.path.removeprefix(root)).stat().st_size and r.modified and not r.error for r in rows)
    flat = listing.list_tree(spark, str(odd_folder), recursive=False).collect()
    assert {r.path.removeprefix(root) for r in flat} == {w for w in want if "/" not in w}
    assert listing.list_tree(spark, str(odd_folder / "empty")).count() == 0
    with pytest.raises(FileNotFoundError):
        listing.list_tree(spark, str(odd_folder / "nothing"))


def test_a_folder_that_cannot_be_listed_is_told():
    batch = pa.RecordBatch.from_pydict({"path": ["file:/no/such/folder"]})
    (found,) = listing._listed(iter([batch]))
    assert found.to_pylist()[0]["error"].startswith("FileNotFoundError") and found.to_pylist()[0]["length"] is None


def test_hidden_files_count_in_a_batch(spark, odd_folder, tmp_path):
    _, outcome = files.load_images(spark, str(odd_folder))
    told = {r.path.split("/in/")[1]: r for r in files.judge_loads(outcome).collect()}
    assert set(told) == {"_a.png", ".b.png", "c.png", ".hidden/d.png", "_e/f/g.png", "x" * 200 + ".png", "link.png"}
    assert {k for k, r in told.items() if r.success} == {"c.png", "x" * 200 + ".png", "link.png"}
    assert told[".b.png"].issues == [files.PASSED_OVER]
    summary = conversion.convert_files(spark, JobSpec(input_dir=str(odd_folder), output_dir=str(tmp_path / "out"))).first()
    assert (summary.total, summary.success, summary.fail) == (7, 3, 4)


def test_decode(spark, folder, monkeypatch):
    monkeypatch.setattr(files, "BAND_BYTES", 16)
    rows, outcome = files.load_images(spark, str(folder))
    by_id = {r.texture_id: r for r in outcome.collect()}
    assert {r.path.rsplit("/", 1)[1]: r.has_result for r in by_id.values()} == {
        "a_diff.PNG": True, "b_nrm.png": True, "grey_rough.png": True, "bad.png": False, "x.dds": False,
    }
    got = {}
    for r in rows.collect():
        got.setdefault(by_id[r.texture_id].path.rsplit("/", 1)[1], {})[r.x, r.y] = (r.r, r.g, r.b, r.a)
    assert got == {
        "a_diff.PNG": {(x, y): (x, y, x + y, 255) for x in range(5) for y in range(3)},
        "b_nrm.png": {(x, y): (9, 8, 7, x * 10) for x in range(4) for y in range(4)},
        "grey_rough.png": {(x, 0): (x, x, x, 255) for x in range(7)},
    }


def test_rejects(spark, folder):
    _, outcome = files.load_images(spark, str(folder))
    ok, bad = files.split_rejects(outcome)
    assert names(ok) == {"a_diff.PNG", "b_nrm.png", "grey_rough.png"}
    assert {(r.path.rsplit("/", 1)[1], tuple(r.issues)) for r in bad.collect()} == {
        ("bad.png", ("The PNG parser gave no result",)), ("x.dds", ()),
    }


@pytest.mark.parametrize(
    "fmt, result, noisy, buffered, d4, success, issues",
    [
        ("PNG", True, True, False, False, True, []),
        ("PNG", False, True, False, False, False, ["w"]),
        ("PNG", False, False, False, False, False, ["The PNG parser gave no result"]),
        ("DDS", True, True, False, False, False, ["w"]),
        ("DDS", True, True, True, False, True, []),
        ("DDS", False, False, True, False, False, ["The DDS parser gave no result"]),
        ("DDS", False, False, False, False, False, []),
        ("TEX", False, False, False, True, False, ["The split TEX parser gave no result"]),
        ("TEX", True, True, True, True, False, ["w"]),
        ("Unknown", True, False, False, False, False, ["Unsupported input format"]),
    ],
)
def test_judge_loads(spark, fmt, result, noisy, buffered, d4, success, issues):
    df = spark.createDataFrame(
        [(fmt, result, ["w"] if noisy else [], buffered, d4)],
        "file_format string, has_result boolean, issues array<string>, from_buffer boolean, is_d4 boolean",
    )
    row = files.judge_loads(df).first()
    assert (row.success, row.issues) == (success, issues)


def test_guard(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    assert sinks.guard_sink(spark, "", out) == sinks.NO_INPUT
    assert sinks.guard_sink(spark, str(folder), "") == sinks.NO_OUTPUT
    assert sinks.guard_sink(spark, str(tmp_path / "gone"), out) == sinks.MISSING_INPUT
    assert sinks.guard_sink(spark, str(folder), f"file:{folder}/") == sinks.SAME_FOLDER
    none = files.scan_assets(spark, str(folder), enabled={"TGA"})
    assert sinks.guard_sink(spark, str(folder), out, none) == sinks.NO_MATCH
    assert sinks.guard_sink(spark, str(folder), out, files.scan_assets(spark, str(folder))) is None


def test_convert_files(spark, folder, tmp_path):
    spec = JobSpec(
        input_dir=str(folder), output_dir=str(tmp_path / "out"), dds_mode=1, dds_format_normal=8,
        dds_invert_y_normal=True, steps=(Step("downscale"),),
    )
    summary = conversion.convert_files(spark, spec).first()
    assert (summary.total, summary.success, summary.fail) == (5, 2, 3)
    written = spark.read.parquet(f"{spec.output_dir}/pixels")
    manifest = {r.output_path: r for r in spark.read.parquet(f"{spec.output_dir}/manifest").collect()}
    assert set(manifest) == {f"{spec.output_dir}/a_diff.dds", f"{spec.output_dir}/sub/b_nrm.dds"}
    normal = manifest[f"{spec.output_dir}/sub/b_nrm.dds"]
    assert normal.target_format == "BC3"
    got = written.filter(F.col("texture_id") == normal.texture_id).collect()
    assert len(got) == 4 and {r.a for r in got} != {255}
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        conversion.convert_files(spark, spec)
    assert conversion.convert_files(spark, spec, overwrite=True).first().success == 2


def test_same_output_keeps_the_lowest_path(spark):
    plan = spark.createDataFrame([("a/x.png", "o/x"), ("b/x.png", "o/x"), ("c/y.png", "o/y")], "path string, output_path string")
    got = {r.path: r.is_duplicate for r in planning.mark_collisions(plan).collect()}
    assert got == {"a/x.png": False, "b/x.png": True, "c/y.png": False}


@pytest.mark.parametrize(
    "spec, columns",
    [
        (JobSpec(output_format=0, blp_encoding=4), {"blp_version": "BLP2", "target_format": "BC1", "needs_convert": True}),
        (JobSpec(output_format=0, blp_encoding=2), {"blp_version": "BLP1", "blp_encoding": "Palettized", "target_format": "RGBA8"}),
        (JobSpec(output_format=3), {"target_format": "RGBA8", "needs_convert": True}),
        (JobSpec(output_format=4, generate_mipmaps=True, mipmap_mode=1), {"intermediate_format": "RGBA8", "out_mips": 4, "needs_convert": False}),
        (JobSpec(output_format=2), {"target_format": "BC7", "intermediate_format": "BC3"}),
        (JobSpec(output_format=2, dds_format_general=8), {"swap_ra": True, "intermediate_format": "RGBA8", "target_format": "BC3"}),
        (JobSpec(output_format=2, dds_invert_y_general=True, dds_format_general=3), {"invert_g": True, "intermediate_format": "RGBA8"}),
        (JobSpec(output_format=2, steps=(Step("downscale", levels=2),)), {"working_format": "RGBA32F", "out_width": 2, "out_mips": 1}),
        (JobSpec(output_format=2, steps=(Step("upscale", scale=3),)), {"out_width": 24, "out_mips": 4, "intermediate_format": "RGBA8"}),
    ],
)
def test_batch_plan(spark, spec, columns):
    df = spark.createDataFrame(
        [(1, "in/t_diff.tga", "BC3", 8, 8, 3)],
        "texture_id bigint, path string, pixel_format string, width int, height int, mip_count int",
    )
    row = planning.batch_plan(df, spec).first().asDict()
    assert {c: row[c] for c in columns} == columns


def test_planning_does_not_shuffle(spark):
    df = spark.createDataFrame(
        [(1, "in/t.tga", "BC3", 8, 8, 3)],
        "texture_id bigint, path string, pixel_format string, width int, height int, mip_count int",
    )
    plan = planning.batch_plan(df, JobSpec(steps=(Step("downscale"),)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_many_small_images_are_staged_in_few_files(spark, monkeypatch, tmp_path):
    """Spark deals 32 files to a task, whatever their size: each task was a staged file, and one more for each share."""
    for k in range(0, 400):
        (tmp_path / f"{k}.bmp").write_bytes(fx._bitmap(k, [0.0] * 64))
    staged, plain = [], files.stage
    monkeypatch.setattr(files, "stage", lambda *a: staged.append(plain(*a)) or staged[-1])
    rows, outcome = files.load_images(spark, str(tmp_path))
    assert rows.count() == 400 * 64 and outcome.filter("has_result").count() == 400
    assert 0 < len(staged[0].inputFiles()) <= spark.sparkContext.defaultParallelism
