"""Tiles against pixel rows, and requests that share steps."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from texelyard.operators import mips, pixels, tiles
from texelyard.plans import jobs

PIXEL = ["texture_id", "width", "height", "mip", "x", "y", "r", "g", "b", "a"]
SIZES = [(1, 300, 130, "Normal"), (2, 65, 64, "Diffuse"), (3, 127, 200, "Normal"), (4, 1, 1, "Diffuse"), (5, 5, 300, "Multikind"), (6, 640, 129, "Normal"), (7, 64, 63, "Diffuse"), (8, 4200, 3, "Normal")]


def textures(spark, sizes):
    sides = spark.createDataFrame(sizes, "texture_id long, width int, height int, kind string")
    rows = sides.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)))
    value = [F.pmod(F.xxhash64("texture_id", "k", F.lit(i)), F.lit(256)).cast("int").alias(c) for i, c in enumerate("rgba")]
    return rows.select(
        "texture_id", "width", "height", "kind", F.lit(0).alias("mip"), (F.col("k") % F.col("width")).alias("x"), F.expr("cast(k div width AS int)").alias("y"), *value
    ).cache()


def rows_of(df):
    return Counter(map(tuple, df.select(*PIXEL).collect()))


@pytest.mark.parametrize("levels", [None, 3])
def test_pyramid_has_the_values_of_the_chain(spark, levels):
    source = textures(spark, SIZES)
    kinds = source.select("texture_id", "kind").distinct()
    patches = tiles.tile_pyramid(tiles.to_tiles(source), levels, kinds)
    assert rows_of(tiles.pixels_of(patches)) == rows_of(mips.mip_chain(source, levels))


def test_no_pixels_are_shuffled_for_six_levels(spark):
    made = tiles.to_tiles(textures(spark, SIZES[:3]))
    plan = tiles.tile_pyramid(made, 2)._jdf.queryExecution().executedPlan().toString()
    assert "data" not in "".join(line for line in plan.splitlines() if "Exchange hash" in line and "programs" in line)
    seeds = tiles.run_programs(made, made.filter("tx = 0 AND ty = 0").select("texture_id", F.expr(
        "array(named_struct('kind', '', 'unused', cast(null AS array<boolean>), 'halve', 0, 'scale', 1, 'anew', true, 'levels', 9))").alias("programs")))
    deep = seeds.filter("mip > 6").agg(F.sum(F.length("data") / 4)).first()[0]
    assert deep < sum(w * h for _, w, h, _ in SIZES[:3]) / 1000


def test_shared_steps_are_computed_once(monkeypatch):
    """Two requests that share a downscale: it is evaluated once, and so is what stands above it."""
    counted = Counter()
    for name in ("halved", "enlarged", "values"):
        def spy(*args, _of=getattr(tiles, name), _name=name):
            counted[_name] += 1
            return _of(*args)

        monkeypatch.setattr(tiles, name, spy)
    rng = np.random.default_rng(3)
    tile = tiles.Tile(rng.integers(0, 256, (64, 64, 4), np.uint8), True)
    base = {"kind": "Diffuse", "unused": None, "halve": 2, "anew": True, "levels": 1}
    one = list(tile.levels({**base, "scale": 2}))
    assert counted == {"halved": 2, "values": 1, "enlarged": 1}
    two = list(tile.levels({**base, "scale": 4}))
    same = list(tile.levels({**base, "scale": 2, "levels": 1}))
    assert counted == {"halved": 2, "values": 1, "enlarged": 2}
    assert one[0][2].shape == (32, 32, 4) and two[0][2].shape == (64, 64, 4) and (same[0][2] == one[0][2]).all()


REQUESTS = [
    # texture, request, kind, channel kinds, halvings, factor, levels made anew, levels, green, swap
    (1, 10, "Normal", None, 1, 1, True, 9, True, False),
    (1, 11, "Normal", None, 1, 1, True, 3, False, True),
    (1, 12, "Normal", None, 1, 2, True, 4, False, False),
    (1, 13, "Diffuse", None, 1, 1, False, 2, False, False),
    (3, 14, "Normal", None, 2, 4, True, 10, True, True),
    (3, 15, "Normal", None, 2, 1, False, 1, False, False),
    (5, 16, "Multikind", ["AmbientOcclusion", "Roughness", "Metalness", "Unused"], 0, 2, True, 8, False, False),
    (6, 17, "Diffuse", None, 0, 1, False, 1, False, True),
    (6, 18, "Normal", None, 0, 3, True, 11, False, False),
]


def test_requests_on_many_tiles_equal_the_row_operators(spark):
    source = textures(spark, SIZES)
    schema = "texture_id long, request_id long, kind string, channel_kinds array<string>, halve int, scale int, anew boolean, out_mips int, invert_g boolean, swap_ra boolean"
    plan = spark.createDataFrame([*REQUESTS, (7, 19, None, None, 1, 1, False, 1, False, False)], schema)
    plan = plan.withColumns({"success": F.col("request_id") != 19, "target_format": F.lit("BC7")})
    found = jobs.convert_job_pixels(plan, source)
    got = {r: Counter() for r in range(10, 20)}
    for row in found.select("request_id", *PIXEL).collect():
        got[row[0]][tuple(row[1:])] += 1
    assert not got[19]
    for texture, request, kind, parts, halve, scale, anew, levels, green, swap in REQUESTS:
        rows = source.filter(F.col("texture_id") == texture).withColumn("kind", F.lit(kind)).withColumn("channel_kinds", F.lit(parts).cast("array<string>"))
        if not anew:
            rows = mips.downscale(rows, halve, levels=levels + halve, deepest_level=levels + halve) if halve else rows
        else:
            rows = mips.downscale(rows, halve) if halve else rows
            rows = pixels.upscale(rows, scale) if scale > 1 else rows
            rows = mips.mip_chain(rows, levels)
        rows = pixels.invert(rows, "g") if green else rows
        rows = pixels.swap(rows, "r", "a") if swap else rows
        assert got[request] == rows_of(rows), request


def test_empty_tables(spark):
    none = textures(spark, SIZES).limit(0)
    assert tiles.pixels_of(tiles.tile_pyramid(tiles.to_tiles(none))).count() == 0


def test_patches_are_expanded_a_few_at_a_time():
    """A batch of 10,000 patches of 64 x 64 pixels was expanded at once: 41 million rows in memory."""
    import pyarrow as pa

    patches = pa.RecordBatch.from_pydict({"mip": [0] * 40, "data": [bytes(4 * n) for n in [64] * 38 + [900, 3]]})
    parts = list(tiles._parts(patches.slice(1), 256))
    assert [sum(len(d) // 4 for d in p.column(1).to_pylist()) for p in parts] == [256] * 9 + [64, 900, 3]
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([patches.slice(1)]))
    assert list(tiles._parts(patches.slice(0, 0), 256)) == []
