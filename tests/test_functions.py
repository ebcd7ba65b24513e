"""Column expressions on hand-written edge cases."""

import pytest
from pyspark.sql import functions as F

from texelyard.functions import binary, colour, formats, kinds, paths, rules


def values(spark, rows, **exprs):
    """Evaluate expressions over rows of a one-column table ``v``."""
    df = spark.createDataFrame([(v,) for v in rows], "v " + ("string" if isinstance(rows[0], str) else "bigint"))
    return [tuple(r) for r in df.select(*[e.alias(n) for n, e in exprs.items()]).collect()]


def v():
    return F.col("v")


@pytest.mark.parametrize(
    "path, stem, ext",
    [
        (".dds", ".dds", ""),
        ("a.b.DDS", "a.b", ".dds"),
        ("noext", "noext", ""),
        ("dir.blp/file", "file", ""),
        ("d/x_AO.PNG", "x_ao", ".png"),
        ("d/..", "..", ""),
        ("d/..a", ".", ".a"),
        ("d/foo.", "foo", "."),
        ("d/.", ".", ""),
        ("d/", "", ""),
        ("É_AO.Png", "É_ao", ".png"),
        ("x_masK.png", "x_masK", ".png"),
    ],
)
def test_path_parts(spark, path, stem, ext):
    assert values(spark, [path], s=paths.stem(v()), e=paths.ext(v())) == [(stem, ext)]


def test_entry_ext_uses_the_last_dot_anywhere(spark):
    assert values(spark, ["dir.blp/file", ".DDS", "x"], e=paths.entry_ext(v())) == [(".blp/file",), (".dds",), ("",)]


def test_parent_and_output(spark):
    rows = ["a/b/c.png", "c.png", "a/c.png"]
    assert values(spark, rows, p=paths.parent(v()), r=paths.relative_parent(v(), "a/")) == [
        ("a/b", "b"), ("", ""), ("a", ""),
    ]


@pytest.mark.parametrize(
    "path, out",
    [
        ("metal/meta/x.tex", "payloadl/meta/x.tex"),
        ("base/meta/x.tex", "base/payload/x.tex"),
        ("base/m/x.tex", ""),
        ("meta", "payload"),
    ],
)
def test_replace_meta_takes_the_first_text_hit(spark, path, out):
    assert values(spark, [path], r=paths.replace_meta(v(), "payload")) == [(out,)]


def test_base_name(spark):
    rows = ["base:a\\b-c.dat", "x/y:z", "plain"]
    assert values(spark, rows, b=paths.base_name(v())) == [("b-c.dat",), ("z",), ("plain",)]


@pytest.mark.parametrize(
    "stem, fmt, kind",
    [
        ("wall_metalness_roughness", "BC7", "Roughness"),
        ("wall_orm_normal", "BC7", "Multikind"),
        ("wall_n", "BC7", "Diffuse"),
        ("plain", "BC5", "Normal"),
        ("plain", "RG16", "Normal"),
        ("plain", "BC4", "Roughness"),
        ("plain", "R32F", "Roughness"),
        ("plain", "RGBA8", "Diffuse"),
        ("plain", None, "Diffuse"),
        ("xao", "RGBA8", "Diffuse"),
    ],
)
def test_guess_kind(spark, stem, fmt, kind):
    df = spark.createDataFrame([(stem, fmt)], "s string, f string")
    assert df.select(kinds.guess_kind(F.col("s"), F.col("f"))).first()[0] == kind


def test_every_rule_can_win(spark):
    got = values(spark, [part for part, _ in rules.KIND_RULES], k=kinds.guess_kind(v(), F.lit("RGBA8")))
    assert [k for (k,) in got] == [kind for _, kind in rules.KIND_RULES]


def test_channel_kinds(spark):
    got = values(spark, ["a_orm_tint", "a_tint", "a"], k=kinds.channel_kinds(v()))
    assert [k for (k,) in got] == [
        ["AmbientOcclusion", "Roughness", "Metalness", "Unused"],
        ["AlphaMask", "AlphaMask", "AlphaMask", "Unused"],
        ["Other"] * 4,
    ]


def test_mip_counts(spark):
    rows = [1, 2, 3, 4, 5, 1023, 1024, 16384, 2**30]
    full = values(spark, rows, m=formats.max_mips(v(), F.lit(1)))
    assert [m for (m,) in full] == [v.bit_length() for v in rows]
    custom = values(spark, [0, 3, 99], m=formats.effective_mips(2, v(), F.lit(8), F.lit(3)))
    assert custom == [(1,), (3,), (4,)]
    assert values(spark, [8], m=formats.effective_mips(0, 5, v(), v())) == [(0,)]


def test_downscale_guard(spark):
    assert values(spark, [1, 2, 3, 4], one=formats.can_downscale(v(), v(), 1), two=formats.can_downscale(v(), v(), 2)) == [
        (False, False), (True, False), (True, False), (True, True),
    ]


@pytest.mark.parametrize("fmt, w, h, size", [("BC1", 5, 3, 16), ("BC7", 1, 1, 16), ("R8", 3, 5, 15), ("RGBA32F", 2, 2, 64)])
def test_level_bytes(spark, fmt, w, h, size):
    df = spark.createDataFrame([(fmt, w, h)], "f string, w int, h int")
    assert df.select(formats.level_bytes(F.col("f"), F.col("w"), F.col("h"))).first()[0] == size


def test_option_clamps(spark):
    assert values(spark, [0, 2, 3, 6, 7], one=formats.clamp_blp(0, v()), two=formats.clamp_blp(1, v())) == [
        (2, 0), (2, 2), (3, 3), (2, 6), (2, 0),
    ]
    got = values(
        spark, list(range(9)),
        normal=formats.clamp_dds(F.lit("Normal"), v()), channel=formats.clamp_dds(F.lit("Gloss"), v()),
        other=formats.clamp_dds(F.lit("Multikind"), v()),
    )
    assert [g[0] for g in got] == [0, 0, 0, 0, 0, 5, 0, 0, 8]
    assert [g[1] for g in got] == [0, 0, 0, 0, 4, 0, 0, 0, 0]
    assert [g[2] for g in got] == [0, 1, 2, 3, 0, 0, 6, 7, 0]


def test_colour(spark):
    got = values(spark, [-10, 0, 1, 127, 300], u=colour.to_u8(v() / 255.0))
    assert [u for (u,) in got] == [0, 0, 1, 127, 255]
    assert values(spark, [1, 2], g=colour.grey(v(), F.lit(1), F.lit(0))) == [(1,), (1,)]


def test_binary_words(spark):
    df = spark.createDataFrame([(bytes.fromhex("F500CF44FFFFFFFF"),)], "b binary")
    assert tuple(df.select(binary.le_u32(F.col("b")), binary.le_u32(F.col("b"), 4)).first()) == (0x44CF00F5, 2**32 - 1)
    assert values(spark, [0x44CF00F5, 1, -1], h=binary.le_hex(v())) == [("F500CF44",), ("01000000",), ("FFFFFFFF",)]


def test_strip_header(spark):
    magic = 0xDEADBEEF
    head = magic.to_bytes(4, "little") + bytes(12)
    rows = [head, head + b"x", bytes(16) + b"x", b"", head + b"xyz"]
    df = spark.createDataFrame([(bytearray(r),) for r in rows], "b binary")
    got = [bytes(r[0]) for r in df.select(binary.strip_header(F.col("b"), magic)).collect()]
    assert got == [head, b"x", bytes(16) + b"x", b"", b"xyz"]


def test_display_defaults(spark):
    assert values(spark, ["Multikind", "Unused", "ORM", "?"], k=kinds.display_name(v(), "kind")) == [
        ("Multi-Kind",), ("Unused",), ("ORM (Legacy)",), ("Unknown",),
    ]
