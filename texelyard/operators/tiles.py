"""Textures as tiles: aligned squares of pixels, one BINARY value each.

A tile covers 64 x 64 pixels of level 0; the last tile of a row or column also takes what is left, up to
127. Halving a side six times then keeps every tile's pixels within the tile, odd last columns included, so
six levels need no other tile. At that level a tile is a few texels, whose exact sums are the input of the
levels below: about one row per 4,096 pixels is shuffled, instead of every pixel.

What is computed for a tile is a program: halve, enlarge, make levels. Programs of one texture are
evaluated together, and what several begin with is computed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from texelyard.functions.formats import max_mips
from texelyard.functions.lookups import as_col
from texelyard.session import ship_package, stage

BITS = 6
SIDE = 1 << BITS
BATCH_BYTES = 4 << 20
TEXELS_AT_ONCE = 1 << 16  # expanded to rows, about 100 bytes each

TILES = "texture_id bigint, width int, height int, tx int, ty int, data binary"
# kind and channel_kinds as the request has them; halvings, factor, whether levels are made anew, and their number.
PROGRAM = "kind string, unused array<boolean>, halve int, scale int, anew boolean, levels int"
NODE = ["kind", "halve", "scale", "anew"]
PATCHES = (
    "texture_id bigint, kind string, halve int, scale int, anew boolean, width int, height int, levels int, mip int, "
    "x0 int, y0 int, cols int, sums boolean, data binary"
)


def tiles_along(side: Column) -> Column:
    return F.greatest(F.lit(1), F.shiftright(side, BITS))


def to_tiles(pixel_rows: DataFrame) -> DataFrame:
    """Tiles of level 0 from pixel rows, which must be complete: one shuffle on texture and tile."""
    ship_package(pixel_rows.sparkSession)
    spot = {c: F.least(F.shiftright(a, BITS), tiles_along(F.col(s)) - 1) for c, a, s in (("tx", "x", "width"), ("ty", "y", "height"))}
    colour = reduce(lambda value, c: value * 256 + F.col(c), "gba", F.col("r").cast("bigint"))
    cols = F.when(F.col("tx") == tiles_along(F.col("width")) - 1, F.col("width") - F.col("tx") * SIDE).otherwise(SIDE)
    place = (F.col("y") - F.col("ty") * SIDE) * cols + F.col("x") - F.col("tx") * SIDE
    level = pixel_rows.filter("mip = 0").withColumns(spot).withColumn("texel", F.shiftleft(place.cast("bigint"), 32).bitwiseOR(colour))
    grouped = level.groupBy("texture_id", "tx", "ty").agg(F.max("width").alias("width"), F.max("height").alias("height"), F.collect_list("texel").alias("texels"))
    return grouped.select("texture_id", "width", "height", "tx", "ty", "texels").mapInArrow(_packed, TILES)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(5)
        flat, bounds = lists.values.to_numpy(), lists.offsets.to_numpy()
        data = [(np.sort(flat[a:b]) & 0xFFFFFFFF).astype(">u4").tobytes() for a, b in zip(bounds, bounds[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(data, pa.binary())], ["texture_id", "width", "height", "tx", "ty", "data"])


def halved(sums: np.ndarray) -> np.ndarray:
    """Sums one level coarser; an odd last row or column is folded inwards."""
    for axis in (0, 1):
        sums = np.add.reduceat(sums, np.arange(max(1, sums.shape[axis] >> 1)) * 2, axis=axis)
    return sums


def values(sums: np.ndarray, normal: bool) -> np.ndarray:
    """Rounded means of channel sums and counts (last plane); vectors are renormalised."""
    n = sums[..., 4:]
    mean = (sums[..., :4] * 2 + n) // (n * 2)
    if normal:
        v = sums[..., :3] / n / 255 * 2 - 1
        length = np.sqrt(v[..., 0] * v[..., 0] + v[..., 1] * v[..., 1] + v[..., 2] * v[..., 2])[..., None]
        unit = np.where(length > 0, v / np.where(length > 0, length, 1), [0.0, 0.0, 1.0])
        mean[..., :3] = np.floor(np.clip((unit + 1) / 2 * 255 + 0.5, 0, 255))
    return mean.astype(np.uint8)


def as_sums(pixels: np.ndarray) -> np.ndarray:
    return np.concatenate([pixels.astype(np.int64), np.ones((*pixels.shape[:2], 1), np.int64)], axis=2)


def enlarged(pixels: np.ndarray, scale: int, multikind: bool, unused: list[bool] | None) -> np.ndarray:
    """Each pixel repeated; multikind channels stay independent, unused ones are 0, else alpha is opaque."""
    grown = pixels.repeat(scale, axis=0).repeat(scale, axis=1)
    if multikind:
        grown[..., np.array(unused or [False] * 4)] = 0
    else:
        grown[..., 3] = 255
    return grown


class Tile:
    """Programs over one tile; what they share is computed once and kept in ``known``."""

    def __init__(self, pixels: np.ndarray, alone: bool) -> None:
        self.pixels, self.alone = pixels, alone
        self.known: dict[tuple, np.ndarray] = {}

    def get(self, key: tuple, make) -> np.ndarray:
        if key not in self.known:
            self.known[key] = make()
        return self.known[key]

    def sums(self, level: int) -> np.ndarray:
        return self.get(("sums", level), lambda: halved(self.sums(level - 1)) if level else as_sums(self.pixels))

    def base(self, program: dict) -> np.ndarray:
        """Level 0 of a program."""
        normal, halve, scale = program["kind"] == "Normal", program["halve"], program["scale"]
        small = self.get(("halve", halve, normal and halve > 0), lambda: values(self.sums(halve), normal and halve > 0))
        if scale == 1:
            return small
        multikind = program["kind"] == "Multikind"
        unused = tuple(program["unused"] or ()) if multikind else ()
        return self.get(("scale", halve, normal and halve > 0, scale, multikind, unused), lambda: enlarged(small, scale, multikind, list(unused)))

    def levels(self, program: dict) -> Iterator[tuple[int, bool, np.ndarray]]:
        """Level, whether it is sums for the levels below, and its pixels, as far as this tile alone tells."""
        normal, halve, scale, count = program["kind"] == "Normal", program["halve"], program["scale"], program["levels"]
        inside = BITS - halve + ((scale & -scale).bit_length() - 1)
        last = count - 1 if self.alone else min(count - 1, inside)
        base = self.base(program)
        yield 0, False, base
        now = as_sums(base) if program["anew"] and count > 1 else None
        for level in range(1, last + 1):
            now = halved(now) if program["anew"] else self.sums(halve + level)
            yield level, False, values(now, normal)
        if count - 1 > last:
            yield last, True, now if now is not None else self.sums(halve)


def run_programs(tiles: DataFrame, programs: DataFrame) -> DataFrame:
    """Patches of every program of every texture: squares of one level, as ``PATCHES``.

    ``programs`` has ``texture_id`` and ``programs``, an array of distinct ``PROGRAM`` structs. Tiles and programs meet
    on the texture, one row a tile; Spark picks the join by size and splits a texture with many tiles. Levels that a
    tile alone tells are made where the tile is; only the sums of the coarsest of them are shuffled, level by level.
    """
    ship_package(tiles.sparkSession)
    joined = tiles.join(programs, "texture_id").select("texture_id", "width", "height", "tx", "ty", "data", "programs")
    made = joined.mapInArrow(_run, PATCHES)
    deepest = programs.agg(F.max(F.array_max(F.transform("programs", lambda p: p["levels"])))).first()[0] or 1
    if deepest <= 2:
        return made.drop("sums")  # a tile has at least that many levels
    staged = stage(made, "patches")
    return reduce(DataFrame.unionByName, [staged.filter("NOT sums").drop("sums"), *_coarser(staged.filter("sums"), deepest)])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for batch in batches:
        heads = zip(*(batch.column(k).to_pylist() for k in range(5)), batch.column(6).to_pylist())
        for (ident, width, height, tx, ty, programs), cell in zip(heads, batch.column(5)):
            wide, tall = max(1, width >> BITS), max(1, height >> BITS)
            cols = width - tx * SIDE if tx == wide - 1 else SIDE
            tile = Tile(np.frombuffer(cell.as_buffer(), np.uint8).reshape(-1, cols, 4), wide == tall == 1)
            for p in programs:
                halve, scale = p["halve"], p["scale"]
                sides = [max(1, side >> halve) * scale for side in (width, height)]
                p["levels"] = min(p["levels"], max(sides).bit_length())  # never more than the size allows
                for level, sums, pixels in tile.levels(p):
                    x0, y0 = ((t * SIDE >> halve) * scale >> level for t in (tx, ty))
                    data = pixels.tobytes()
                    rows.append((ident, p["kind"], halve, scale, p["anew"], *sides, p["levels"], level, x0, y0, pixels.shape[1], sums, data))
                    held += len(data)
                if held > BATCH_BYTES:
                    yield _patches(rows)
                    rows, held = [], 0
    if rows:
        yield _patches(rows)


_PATCH_TYPES = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), *[pa.int32()] * 7, pa.bool_(), pa.binary()]
_PATCH_NAMES = [f.split()[0] for f in PATCHES.split(", ")]


def _patches(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PATCH_TYPES)], _PATCH_NAMES)


TEXELS = "texture_id bigint, kind string, halve int, scale int, anew boolean, width int, height int, levels int, mip int, tx int, ty int, x int, y int, sums binary"


def _coarser(seeds: DataFrame, deepest: int) -> list[DataFrame]:
    """Levels below those a tile tells: the sums of its coarsest level are the pixels of tiles 64 times as large."""
    out: list[DataFrame] = []
    first = seeds.agg(F.min("mip")).first()[0]
    while first is not None and first < deepest - 1:
        texels = seeds.drop("sums").mapInArrow(_texels, TEXELS)
        folded = stage(texels.groupBy("texture_id", *NODE, "mip", "tx", "ty").applyInArrow(_folded, PATCHES), "patches")
        out.append(folded.filter("NOT sums").drop("sums"))
        seeds, first = folded.filter("sums"), first + BITS
    return out


def _texels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [np.frombuffer(c.as_buffer(), np.int64).reshape(-1, 5) for c in batch.column("data")]
        size = np.array([len(p) for p in parts], np.int64)
        row = np.repeat(np.arange(len(parts)), size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        held = {c: batch.column(c).to_numpy().astype(np.int64)[row] for c in ("width", "height", "mip", "x0", "y0", "cols")}
        x, y = held["x0"] + at % np.maximum(held["cols"], 1), held["y0"] + at // np.maximum(held["cols"], 1)
        tx, ty = (np.minimum(v >> BITS, np.maximum(held[side] >> held["mip"] >> BITS, 1) - 1) for v, side in ((x, "width"), (y, "height")))
        kept = [batch.column(c).take(pa.array(row)) for c in _PATCH_NAMES[:9]]
        sums = pa.array([s.tobytes() for p in parts for s in p], pa.binary())
        yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v.astype(np.int32)) for v in (tx, ty, x, y)), sums], [f.split()[0] for f in TEXELS.split(", ")])


def _folded(group: pa.Table) -> pa.Table:
    """Levels of one tile of sums; at most 127 x 127 rows."""
    head = {c: group.column(c)[0].as_py() for c in group.column_names[:11]}
    x, y = (group.column(c).to_numpy() for c in "xy")
    now = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1, 5), np.int64)
    now[y - y.min(), x - x.min()] = np.stack([np.frombuffer(c.as_buffer(), np.int64) for c in group.column("sums")])
    first, count = head["mip"], head["levels"]
    alone = all(head[side] >> first >> BITS <= 1 for side in ("width", "height"))
    last = count - 1 if alone else min(count - 1, first + BITS)
    fixed = [head[c] for c in _PATCH_NAMES[:8]]
    rows = []
    for level in range(first + 1, last + 1):
        now = halved(now)
        place = [head[t] * SIDE >> (level - first) for t in ("tx", "ty")]
        rows.append((*fixed, level, *place, now.shape[1], False, values(now, head["kind"] == "Normal").tobytes()))
    if count - 1 > last:
        rows.append((*fixed, last, *(head[t] * SIDE >> (last - first) for t in ("tx", "ty")), now.shape[1], True, now.tobytes()))
    return pa.Table.from_batches([_patches(rows)])


def _texel_counts(data: pa.Array) -> np.ndarray:
    bounds = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int32)
    return np.diff(bounds.astype(np.int64)) // 4


def _parts(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of patches of at most so many texels together, or one patch; patches of a batch may hold a hundred times as many."""
    ends, first = np.cumsum(_texel_counts(batch.column(batch.schema.get_field_index("data")))), 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(first, stop - first)
        first = stop


def pixels_of(patches: DataFrame) -> DataFrame:
    """Pixel rows of patches, with the patches' other columns."""
    ship_package(patches.sparkSession)
    kept = [c for c in patches.columns if c not in ("x0", "y0", "cols", "data")]
    schema = StructType([*patches.select(*kept).schema.fields, *StructType.fromDDL("x int, y int, r int, g int, b int, a int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _parts(whole, TEXELS_AT_ONCE):
                column = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
                texels = np.concatenate([np.frombuffer(c.as_buffer(), np.uint8) for c in column["data"]]).reshape(-1, 4)
                size = _texel_counts(column["data"])
                row = np.repeat(np.arange(len(size)), size)
                at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                x0, y0, cols = (column[c].to_numpy().astype(np.int64)[row] for c in ("x0", "y0", "cols"))
                made = [pa.array((x0 + at % cols).astype(np.int32)), pa.array((y0 + at // cols).astype(np.int32)), *(pa.array(texels[:, k].astype(np.int32)) for k in range(4))]
                index = pa.array(row)
                for first in range(0, len(row), TEXELS_AT_ONCE):
                    part = slice(first, first + TEXELS_AT_ONCE)
                    held = [column[c].take(index[part]) for c in kept]
                    yield pa.RecordBatch.from_arrays([*held, *(m[part] for m in made)], list(schema.names))

    return patches.select(*kept, "x0", "y0", "cols", "data").mapInArrow(run, schema)


def tile_pyramid(tiles: DataFrame, levels: int | Column | None = None, kinds: DataFrame | None = None) -> DataFrame:
    """Patches of regenerated mip levels of every texture; ``kinds`` (texture_id, kind) names the normal maps.

    ``levels`` is a number, a column of ``tiles`` or None for the full chain, clamped to what the texture allows.
    """
    full = max_mips(F.col("width"), F.col("height"))
    wanted = full if levels is None else F.least(F.greatest(as_col(levels), F.lit(1)), full)
    one = tiles.filter("tx = 0 AND ty = 0").select("texture_id", wanted.cast("int").alias("levels"))
    one = one.join(kinds.select("texture_id", "kind"), "texture_id", "left") if kinds is not None else one.withColumn("kind", F.lit(None).cast("string"))
    none = F.lit(None).cast("array<boolean>")
    program = F.struct("kind", none.alias("unused"), F.lit(0).alias("halve"), F.lit(1).alias("scale"), F.lit(True).alias("anew"), "levels")
    return run_programs(tiles, one.select("texture_id", F.array(program).alias("programs"))).drop("levels")
