"""Pixel operators against a plain Python reading of their definition."""

import math
import random

import pytest
from pyspark.sql import functions as F

from texelyard.operators import mips, pixels, steps
from texelyard.spec import Step

SCHEMA = "texture_id bigint, width int, height int, mip int, x int, y int, r int, g int, b int, a int"


def image(ident, w, h, seed=0):
    rng = random.Random(seed + ident)
    return [(ident, w, h, 0, x, y, *[rng.randrange(256) for _ in range(4)]) for y in range(h) for x in range(w)]


def frame(spark, *images):
    return spark.createDataFrame([row for rows in images for row in rows], SCHEMA)


def rows(df):
    return sorted(tuple(r) for r in df.select("texture_id", "width", "height", "mip", "x", "y", "r", "g", "b", "a").collect())


def brute_level(rows_, k):
    """Level k by repeated folding of sums, one step at a time."""
    ident, w, h = rows_[0][:3]
    cells = {(x, y): ([r, g, b, a], 1) for _, _, _, _, x, y, r, g, b, a in rows_}
    for _ in range(k):
        w, h = max(1, w >> 1), max(1, h >> 1)
        folded = {}
        for (x, y), (total, n) in cells.items():
            at = (min(x // 2, w - 1), min(y // 2, h - 1))
            old, count = folded.get(at, ([0] * 4, 0))
            folded[at] = ([p + q for p, q in zip(old, total)], count + n)
        cells = folded
    return {at: tuple((2 * t + n) // (2 * n) for t in total) for at, (total, n) in cells.items()}


SIZES = [(1, 1), (3, 5), (7, 5), (8, 8), (1, 9), (17, 2), (33, 6)]


@pytest.mark.parametrize("w, h", SIZES)
def test_mip_chain(spark, w, h):
    base = image(1, w, h)
    got = {}
    for _, _, _, mip, x, y, *channels in rows(mips.mip_chain(frame(spark, base))):
        got.setdefault(mip, {})[x, y] = tuple(channels)
    levels = max(w, h).bit_length()
    assert sorted(got) == list(range(levels))
    for k in range(levels):
        assert got[k] == brute_level(base, k)


def test_chain_lengths_follow_each_texture(spark):
    df = frame(spark, image(1, 8, 8), image(2, 3, 1), image(3, 1, 1)).withColumn("want", F.col("texture_id").cast("int") * 2)
    found = mips.mip_chain(df, F.col("want")).groupBy("texture_id").agg(F.max("mip")).collect()
    assert {r[0]: r[1] for r in found} == {1: 1, 2: 1, 3: 0}
    assert mips.mip_chain(df, 99).agg(F.max("mip")).first()[0] == 3
    assert mips.mip_chain(df, 0).agg(F.max("mip")).first()[0] == 0


def test_old_levels_are_dropped(spark):
    base = frame(spark, image(1, 4, 4))
    stale = base.withColumn("mip", F.lit(1))
    assert rows(mips.mip_chain(base.unionAll(stale), 2)) == rows(mips.mip_chain(base, 2))


@pytest.mark.parametrize("k", [1, 2])
@pytest.mark.parametrize("w, h", [(3, 5), (7, 5), (8, 8), (33, 6)])
def test_downscale(spark, w, h, k):
    base = image(5, w, h)
    got = rows(mips.downscale(frame(spark, base), k))
    if (w >> k) < 1 or (h >> k) < 1:
        assert got == []
        return
    assert {(r[1], r[2], r[3]) for r in got} == {(w >> k, h >> k, 0)}
    assert {(r[4], r[5]): r[6:] for r in got} == brute_level(base, k)


def test_normals_are_unit_length(spark):
    df = frame(spark, image(1, 8, 8)).withColumn("kind", F.lit("Normal"))
    for r in mips.mip_chain(df).filter("mip > 0").collect():
        v = [c / 255 * 2 - 1 for c in (r.r, r.g, r.b)]
        assert math.isclose(math.sqrt(sum(c * c for c in v)), 1, abs_tol=0.02)


def test_opposed_normals_become_flat(spark):
    base = [(1, 2, 1, 0, 0, 0, 0, 255, 0, 9), (1, 2, 1, 0, 1, 0, 255, 0, 255, 9)]
    df = frame(spark, base).withColumn("kind", F.lit("Normal"))
    top = mips.mip_chain(df).filter("mip = 1").first()
    assert (top.r, top.g, top.b, top.a) == (128, 128, 255, 9)


def test_select_mip_falls_back_to_the_last_level(spark):
    chain = mips.mip_chain(frame(spark, image(1, 8, 8), image(2, 2, 2)))
    for index, want in [(0, {1: 0, 2: 0}), (2, {1: 2, 2: 1}), (50, {1: 3, 2: 1})]:
        found = mips.select_mip(chain, index).select("texture_id", "mip").distinct().collect()
        assert {r[0]: r[1] for r in found} == want


def test_involutions(spark):
    df = frame(spark, image(1, 5, 4))
    assert rows(pixels.swap(pixels.swap(df, "r", "a"), "r", "a")) == rows(df)
    assert rows(pixels.invert(pixels.invert(df, "g"), "g")) == rows(df)
    assert rows(pixels.bc3n_unpack(pixels.bc3n_pack(df, True))) == rows(df)
    assert rows(pixels.bc3n_unpack(pixels.bc3n_pack(df))) == rows(pixels.invert(df, "g"))


def test_channel_filter(spark):
    df = spark.createDataFrame([(1, 1, 1, 0, 0, 0, 10, 20, 30, 40)], SCHEMA)

    def shown(**flags):
        return rows(pixels.channel_filter(df, **flags))[0][6:]

    assert shown() == (10, 20, 30, 40)
    assert shown(r=False, g=False, b=False) == (40, 40, 40, 255)
    assert shown(g=False, b=False, a=False) == (10, 10, 10, 255)
    assert shown(r=False) == (0, 20, 30, 40)
    assert shown(r=False, g=False, b=False, a=False) == (0, 0, 0, 255)


def test_upscale_policy(spark):
    tagged = (
        frame(spark, image(1, 2, 3), image(2, 2, 3))
        .withColumn("kind", F.when(F.col("texture_id") == 1, "Multikind").otherwise("Diffuse"))
        .withColumn("channel_kinds", F.when(F.col("texture_id") == 1, F.array(*map(F.lit, ["Roughness", "Unused", "Gloss", "Other"]))))
    )
    base = {(i, x, y): c for i, _, _, _, x, y, *c in rows(tagged)}
    grown = rows(pixels.upscale(tagged, 3, default=1.0))
    assert len(grown) == 9 * len(base)
    for i, w, h, _, x, y, r, g, b, a in grown:
        src = base[i, x // 3, y // 3]
        assert (w, h) == (6, 9)
        assert (r, g, b, a) == ((src[0], 255, src[2], src[3]) if i == 1 else (*src[:3], 255))
    kept = rows(pixels.upscale(tagged.filter("texture_id = 2"), 2, alpha=True))
    assert all((r, g, b, a) == tuple(base[i, x // 2, y // 2]) for i, _, _, _, x, y, r, g, b, a in kept)


def test_steps_fail_one_asset_and_keep_the_rest(spark):
    df = frame(spark, image(1, 8, 8), image(2, 2, 8), image(3, 1, 1))
    textures = df.select("texture_id", "width", "height", F.lit(4).alias("mip_count")).distinct()
    plan = (Step("downscale", levels=1), Step("upscale", scale=3), Step("downscale", levels=2))
    done, failed, out = steps.run_steps(textures, df, plan)
    assert {r.texture_id: (r.width, r.height, r.mip_count) for r in done.collect()} == {1: (3, 3, 2)}
    assert {r.texture_id: r.failed_step for r in failed.collect()} == {2: 2, 3: 0}
    assert {r[:3] for r in rows(out)} == {(1, 3, 3)}


def test_working_format_is_restored(spark):
    df = frame(spark, image(1, 1, 1), image(2, 1, 1)).withColumn("pixel_format", F.when(F.col("texture_id") == 1, "BC4").otherwise("R8"))
    df = df.withColumn("kind", F.lit("Gloss"))
    seen = steps.with_working_format(
        df, lambda d: d.withColumns({"seen": F.col("pixel_format"), "kind": F.lit("lost"), "pixel_format": F.lit("RGBA32F")})
    )
    got = {r.texture_id: (r.seen, r.pixel_format, r.kind) for r in seen.collect()}
    assert got == {1: ("R32F", "BC4", "Gloss"), 2: ("R8", "RGBA32F", "Gloss")}


def test_texture_columns_reach_every_band(spark):
    df = frame(spark, image(1, 1, 200), image(2, 2, 64), image(3, 1, 1), image(4, 1, 65))
    textures = df.groupBy("texture_id").agg(F.max("height").alias("height")).withColumn("tag", F.col("texture_id") * 10)
    for threshold in ("-1", "10MB"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        got = pixels.with_texture(df, textures.filter("texture_id < 4"))
        assert rows(got) == [r for r in rows(df) if r[0] < 4]
        assert got.filter("tag <> texture_id * 10").isEmpty()


def test_no_task_owns_a_texture(spark):
    """After a shuffled join, aggregations exchange on the position, not on the texture."""
    df = frame(spark, image(1, 8, 8))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    joined = pixels.with_texture(df, df.groupBy("texture_id").agg(F.max("height").alias("height")))
    plan = mips.downscale(joined, 1)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    top = plan[: plan.index("Join")]
    assert "Exchange hashpartitioning(texture_id" in top and "partial_sum" in top


def test_chain_reads_its_input_twice_and_shuffles_levels_once(spark):
    import re

    chain = mips.mip_chain(frame(spark, image(1, 8, 8)), deepest_level=4)
    chain.collect()
    plan = chain._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    ids = set(re.findall(r"(?<!Reused)Exchange hashpartitioning.*plan_id=(\d+)", plan))
    assert "ReusedExchange" in plan and len(ids) <= 5
