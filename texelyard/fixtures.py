"""Derived views over the given tables, one Spark plan each.

The tables hold no textures, so assets, listings, packed files, pixels and
events are derived from them; ``oracle.py`` holds the same views for DuckDB.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texelyard.functions import rules
from texelyard.functions.binary import le_hex
from texelyard.operators.running import ROWS_A_TASK, blocked_running_sum
from texelyard.session import new_folder, ship_package, stage

# --- fixed values of the derived views ------------------------------------
SUFFIXES = [
    "_diff", "_diffuse", "_orm", "_tint", "_ao", "_occlusion", "_roughness", "_rough", "_metal", "_gloss",
    "_smooth", "_spec", "_specular", "_emis", "_emissive", "_alpha", "_mask", "_opacity", "_lightmap", "_envpbr",
    "_ibl", "_envlegacy", "_envmap", "_env", "_reflection", "_albedo", "_basecolor", "_normal", "_nrm", "_norm", "",
]
EXTENSIONS = [".blp", ".bmp", ".DDS", ".jpg", ".jpeg", ".png", ".tex", ".tga", ".txt", ""]
TYPES = ["Texture2D", "Texture3D", "TextureCube"]
SHAPES = [(8, 8), (5, 13), (7, 10), (16, 4)]
PIXEL_KINDS = ["Normal", "Multikind", "Roughness", "Diffuse"]
GROUPS = ["Texture", "Material", "Sound"]
HEADER_MAGIC = 0xDEADBEEF


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, index) -> F.Column:
    """Element of a literal list at a 0-based index."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def div(a, b: int):
    return F.call_function("div", a, F.lit(b))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    path = F.concat(
        F.lit("base/meta/"), F.lower("p_type"), F.lit("/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")),
        F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), pick(SUFFIXES, key % 31), pick(EXTENSIONS, key % 10),
    )
    return table(spark, sf_dir, "part").select(
        key.alias("texture_id"),
        path.alias("path"),
        pick(rules.PIXEL_FORMATS, div(key, 7) % 16).alias("pixel_format"),
        F.expr("shiftleft(1, p_size % 12)").alias("width"),
        F.expr("shiftleft(1, cast((p_size div 5) % 12 as int))").alias("height"),
        (key % 5 + 1).cast("int").alias("mip_count"),
    )


def unique_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets whose path carries the key, so that paths are unique."""
    named = F.regexp_replace("path", "/([^/]*)$", F.concat(F.lit("/"), F.col("texture_id"), F.lit("_$1")))
    return assets(spark, sf_dir).withColumn("path", named)


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assets(spark, sf_dir).select("texture_id", "path")
    tex = a.filter(F.col("path").endswith(".tex"))

    def companion(folder, gap):
        return tex.filter(F.col("texture_id") % gap != 0).select(
            F.replace("path", F.lit("base/meta/"), F.lit(f"base/{folder}/")).alias("path")
        )

    return a.select("path").unionAll(companion("payload", 3)).unionAll(companion("paylow", 4))


def toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        _entry_name(key).alias("name"),
        pick(GROUPS, key % 3).alias("group_name"),
        key.cast("int").alias("sno"),
    )


def _entry_name(key):
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), key)
    return F.when(key % 17 == 0, F.lit("  ")).otherwise(name)


def group_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc(spark, sf_dir).groupBy("group_name").agg(F.max("sno").alias("format_hash"))


def dat_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    path = F.concat(
        pick(["base:", "base\\", "data/x/", ""], key % 4),
        pick(["Texture", "Material", "Texture"], div(key, 4) % 3),
        F.lit("-"), key,
        pick(["-a", "-0xBEEF", "", "-0x", "-x-y-z"], div(key, 12) % 5),
        F.when(key % 11 == 0, ".bin").otherwise(".dat"),
    )
    return table(spark, sf_dir, "part").select(path.alias("path"))


def archive_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive files (path, length) that the table of contents refers to."""
    key = F.col("p_partkey")
    size = F.when(key % 23 == 0, 0).otherwise(F.col("p_size") + 1)
    paths = F.array(
        F.when(key % 5 != 0, F.concat(F.lit("base:payload\\"), key)),
        F.when(key % 3 == 0, F.concat(F.lit("base:paylow\\"), key)),
        F.when(key % 4 == 1, F.concat(F.lit("base:meta\\"), key)),
        F.when(key % 4 == 2, F.concat(F.lit("Base\\meta\\Texture\\"), _entry_name(key), F.lit(".tex"))),
    )
    files = table(spark, sf_dir, "part").select(F.explode(paths).alias("path"), size.cast("bigint").alias("length"))
    return files.filter(F.col("path").isNotNull())


def blob_bytes(blobs: DataFrame) -> DataFrame:
    """:func:`archive_blobs` with bytes of the stated length, half of the payloads behind a header."""
    digits = F.regexp_extract("path", r"(\d+)(\.tex)?$", 1)  # none in a name without an id
    seed = F.when(digits != "", digits).otherwise("0").cast("bigint")
    headed = F.col("path").startswith("base:pay") & (seed % 2 == 0) & (F.col("length") > 0)
    text = F.concat(F.when(headed, F.concat(le_hex(F.lit(HEADER_MAGIC)), F.repeat(F.lit("00"), F.lit(12)))).otherwise(""),
                    F.repeat(le_hex(seed * 257).substr(1, 2), F.col("length").cast("int")))
    return blobs.withColumn("data", F.unhex(text))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries (f, i, n, sno, size), numbered per file in a total order.

    The running number is found block by block of order keys, so one file may
    hold most of the rows. The view is written once, as such an index would be:
    offsets read it twice.
    """
    columns = ["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    lines = table(spark, sf_dir, "lineitem").select(*columns)
    order = columns[1:]
    numbered = blocked_running_sum(lines, "l_suppkey", div(F.col("l_orderkey"), 8192), order, F.lit(1), "i", "n")
    entries = numbered.select(
        F.col("l_suppkey").alias("f"), "i", "n", F.col("l_partkey").alias("sno"),
        (F.col("l_quantity") * 3).cast("int").alias("size"),
    )
    return stage(entries, "packed")


def packed_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One packed file of one to three entries per line, some of them damaged.

    The first entry differs in id and size from the rest of its file.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("f"),
        "l_partkey",
        "l_suppkey",
        (F.col("l_linenumber") % 3 + 1).alias("n"),
        (F.col("l_quantity").cast("int") % 20 + 4).alias("size_a"),
        ((F.col("l_quantity").cast("int") + 3) % 20 + 4).alias("size_b"),
    )
    part, n = F.col("l_partkey"), F.col("n")

    def index(number, size):
        return F.concat(le_hex(part + number), le_hex(F.col(size)))

    def body(number, size):
        stored = part + number + F.when((F.col("l_suppkey") + number) % 11 == 0, 1).otherwise(0)
        filled = F.concat(F.lit("00" * 8), le_hex(stored), F.repeat(F.lit("AB"), F.col(size) - 4))
        return F.rpad(filled, (16 + 2 * _ceil8(F.col(size))).cast("int"), F.lit("00"))

    more = n - 1
    magic = F.when(part % 13 == 0, 1).otherwise(F.lit(rules.PACKED_MAGIC))
    text = F.concat(
        le_hex(magic), le_hex(n), index(0, "size_a"), F.repeat(index(1, "size_b"), more),
        body(0, "size_a"), F.repeat(body(1, "size_b"), more),
    )
    last = F.when(n == 1, F.col("size_a")).otherwise(_ceil8(F.col("size_a")) + (n - 2) * _ceil8(F.col("size_b")) + F.col("size_b"))
    whole = 8 + 16 * n + last
    cut = F.when(part % 19 == 0, 5).when(part % 17 == 0, 12).when(part % 7 == 0, whole - 1).otherwise(whole)
    return lines.select("f", "l_partkey", F.substring(F.unhex(text), F.lit(1), cut).alias("blob"))


def _ceil8(size):
    return F.shiftleft(F.shiftright(size + 7, 3), 3)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level-0 pixels of one small image per vector, in four shapes."""
    key, pos = F.col("vec_id"), F.col("pos")
    v = F.element_at("embedding", (pos % F.size("embedding") + 1).cast("int")).cast("double")
    shaped = table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding",
        pick([w for w, _ in SHAPES], key % 4).alias("width"), pick([h for _, h in SHAPES], key % 4).alias("height"),
    )
    rows = shaped.withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)))
    kind = pick(PIXEL_KINDS, div(key, 4) % 4)
    channel_kinds = F.array(*[F.lit(c) for c in rules.CHANNEL_KIND_RULES[0][1]])
    return rows.select(
        key.alias("texture_id"),
        "width",
        "height",
        kind.alias("kind"),
        pick(rules.PIXEL_FORMATS, div(key, 16) % 16).alias("pixel_format"),
        F.when(kind == "Multikind", channel_kinds).alias("channel_kinds"),
        F.lit(0).alias("mip"),
        (pos % F.col("width")).alias("x"),
        F.floor(pos / F.col("width")).cast("int").alias("y"),
        F.floor((v + 1) / 2 * 255 + 0.5).cast("int").alias("r"),
        ((pos * 37 + key * 11) % 256).cast("int").alias("g"),
        ((pos * pos + key) % 256).cast("int").alias("b"),
        (255 - (pos * 3 + key) % 64).cast("int").alias("a"),
    )


def plain_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).drop("kind", "pixel_format", "channel_kinds")


def stored_levels(key):
    """Levels a texture of :func:`stored_pixels` holds: one to three."""
    return (key % 3 + 1).cast("int")


def stored_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Textures stored with levels of their own, which no box mean gives."""
    key, mip, pos = F.col("vec_id"), F.col("mip"), F.col("pos")
    shaped = table(spark, sf_dir, "embeddings").select(
        "vec_id", pick([w for w, _ in SHAPES], key % 4).alias("width"), pick([h for _, h in SHAPES], key % 4).alias("height")
    )
    rows = shaped.withColumn("mip", F.explode(F.sequence(F.lit(0), stored_levels(key) - 1)))
    rows = rows.withColumn("w", F.expr("greatest(1, shiftright(width, mip))"))
    rows = rows.withColumn("pos", F.explode(F.expr("sequence(0, w * greatest(1, shiftright(height, mip)) - 1)")))
    return rows.select(
        key.alias("texture_id"), "width", "height", "mip",
        (pos % F.col("w")).alias("x"), F.floor(pos / F.col("w")).cast("int").alias("y"),
        ((pos * 5 + key + mip * 70) % 256).cast("int").alias("r"), ((pos * 37 + key * 11 + mip) % 256).cast("int").alias("g"),
        ((pos * pos + key + mip * 3) % 256).cast("int").alias("b"), (255 - (pos * 3 + key + mip) % 64).cast("int").alias("a"),
    )


def pixel_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asset rows that own the pixels."""
    key = F.col("vec_id")
    path = F.concat(F.lit("base/meta/"), F.col("label"), F.lit("/img"), key, pick(["_nrm", "_orm", "_rough", "_diff"], div(key, 4) % 4),
                    pick([".png", ".TGA", ".bmp", ".txt"], div(key, 16) % 4))
    return table(spark, sf_dir, "embeddings").select(
        key.alias("texture_id"), path.alias("path"), F.lit("RGBA8").alias("pixel_format"),
        pick([w for w, _ in SHAPES], key % 4).alias("width"), pick([h for _, h in SHAPES], key % 4).alias("height"),
        F.lit(1).alias("mip_count"),
    )


def opens(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.concat("event_type", F.lit("/"), F.get_json_object("props", "$.k"))
    return table(spark, sf_dir, "events").select("user_id", item.alias("item"), "ts")


def write_bitmaps(spark: SparkSession, sf_dir: str) -> str:
    """Write one image file per vector below the shared folder; returns the folder.

    Most are 8x8 bitmaps, some in upper case; every tenth is a broken ``.png``
    and another tenth a ``.dds`` no image decoder reads. Files have fixed names
    and contents, so a repeated task writes the same again.
    """
    ship_package(spark)
    folder = new_folder(spark, "bitmaps")
    key = F.col("vec_id")
    case = F.when(key % 10 == 7, ".png").when(key % 10 == 8, ".dds").when(key % 10 == 9, ".BMP").otherwise(".bmp")
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.concat("label", F.lit("/img"), key, case).alias("name"), (key % 10).isin(7, 8).alias("broken"), "embedding"
    )
    spread = rows.repartition(spark.sparkContext.defaultParallelism, "vec_id")
    spread.mapInArrow(_bitmap_writer(folder), "name string").write.format("noop").mode("overwrite").save()
    return folder


def write_packed(spark: SparkSession, sf_dir: str) -> str:
    """:func:`packed` as real files below the shared folder, one per ``f``; returns the folder.

    Some have a wrong magic, some end a byte early, and some entries store another id. A file ends behind its last
    entry, whose id of 4 bytes is whole even if its size is less. Names sort by number: the latest file is the last by name.
    """
    ship_package(spark)
    folder = new_folder(spark, "packed-files")
    entries = packed(spark, sf_dir)
    tasks = max(spark.sparkContext.defaultParallelism, -(-entries.count() // ROWS_A_TASK))
    rows = entries.repartition(tasks, "f").sortWithinPartitions("f", "i")

    def write(batches):
        import itertools

        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        lines = (e for b in batches for e in zip(*(b.column(c).to_pylist() for c in ("f", "sno", "size"))))
        for f, own in itertools.groupby(lines, lambda e: e[0]):
            own = list(own)
            index = b"".join(struct.pack("<iI", sno, size) for _, sno, size in own)
            body = b"".join(
                bytes(8) + (struct.pack("<i", sno + ((sno + i) % 11 == 0)) + b"\xab" * max(0, size - 4)).ljust((size + 7) // 8 * 8, b"\0")
                for i, (_, sno, size) in enumerate(own)
            )
            whole = struct.pack("<II", 1 if f % 13 == 0 else rules.PACKED_MAGIC, len(own)) + index + body
            last = own[-1][2]
            pad = (last + 7) // 8 * 8 - max(last, 4)
            with fs.open_output_stream(f"{root}/packed-{f:019d}.dat") as out:
                out.write(whole[: len(whole) - pad - (f % 7 == 0)])
        yield pa.RecordBatch.from_pydict({"f": pa.array([], pa.int64())})

    rows.mapInArrow(write, "f bigint").write.format("noop").mode("overwrite").save()
    return folder


TREE = ["a/img", "_b/img", ".c/d/img", "e/f/g/_img", ".img"]
TREE_EXTENSIONS = [".bmp", ".BMP", ".tex", ".txt"]


def write_tree(spark: SparkSession, sf_dir: str) -> str:
    """Small files below the shared folder, some in hidden folders or under hidden names; returns the folder."""
    folder = new_folder(spark, "tree")
    key = F.col("vec_id")
    name = F.concat(pick(TREE, key % 5), key, pick(TREE_EXTENSIONS, div(key, 5) % 4))
    rows = table(spark, sf_dir, "embeddings").select(name.alias("name"), (key % 7).cast("int").alias("length"))

    def write(batches):
        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for place, length in zip(*[c.to_pylist() for c in batch.columns]):
                fs.create_dir(f"{root}/{place}".rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(f"{root}/{place}") as out:
                    out.write(b"x" * length)
            yield batch.select(["name"])

    rows.mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()
    return folder


def _bitmap_writer(folder: str):
    def write(batches):
        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for vec, name, broken, values in zip(*[c.to_pylist() for c in batch.columns]):
                target = f"{root}/{name}"
                fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(target) as out:
                    out.write(b"not an image" if broken else _bitmap(vec, values))
            yield batch.select(["name"])

    return write


def _bitmap(vec: int, values) -> bytes:
    """An uncompressed 24-bit bitmap, bottom row first."""
    pos = np.arange(64)
    r = np.floor((np.array(values, np.float64) + 1) / 2 * 255 + 0.5)
    bgr = np.stack([(pos * pos + vec) % 256, (pos * 37 + vec * 11) % 256, r], axis=1).astype(np.uint8)
    body = bgr.reshape(8, 24)[::-1].tobytes()
    head = struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, 8, 8, 1, 24, 0, len(body), 0, 0, 0, 0) + body
