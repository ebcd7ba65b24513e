"""Archive listings, tables of contents and packed blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texelyard.functions import paths, rules
from texelyard.functions.binary import header
from texelyard.functions.lookups import as_col
from texelyard.operators.bloom import might_contain
from texelyard.operators.packed import packed_entries


def is_texture(path: Column) -> Column:
    """Whether a listed name has one of the known extensions."""
    return paths.entry_ext(path).isin(list(rules.FORMAT_OF_EXT))


def texture_entries(listing: DataFrame) -> DataFrame:
    """Listing names with one of the known extensions, unsorted."""
    return listing.filter(is_texture(F.col("path")))


def supported_listing(listing: DataFrame) -> DataFrame:
    """:func:`texture_entries` in byte order (a distributed range sort)."""
    return texture_entries(listing).orderBy("path")


def toc_entries(toc: DataFrame, group: str = rules.TEXTURE_GROUP) -> DataFrame:
    """Entries of a group whose name holds a visible ASCII character, unsorted."""
    return toc.filter((F.col("group_name") == group) & F.col("name").rlike("[!-~]"))


def toc_textures(toc: DataFrame, group: str = rules.TEXTURE_GROUP) -> DataFrame:
    return toc_entries(toc, group).orderBy("name", "sno")


def packed_files(df: DataFrame, group: str = rules.TEXTURE_GROUP) -> DataFrame:
    """Packed metadata files of a group, encrypted variants left out."""
    name = paths.base_name(F.col("path"))
    dashes = F.char_length(name) - F.char_length(F.translate(name, "-", ""))
    after_dot = F.substring_index(name, ".", -1)
    bare = F.when(F.instr(name, ".") > 0, F.left(name, F.char_length(name) - F.char_length(after_dot) - 1)).otherwise(name)
    suffix = F.substring_index(bare, "-", -1)
    encrypted = (F.instr(bare, "-") > 0) & (F.char_length(suffix) > 2) & suffix.startswith("0x")
    return df.filter(
        F.col("path").endswith(".dat")
        & (dashes >= 2)
        & ~encrypted
        & (F.substring_index(name, "-", 1) == group)
    )


def slice_with_header(df: DataFrame, magic, format_hash="format_hash") -> DataFrame:
    """Replace ``blob`` by ``data``: its slice (start, size) behind a 16-byte header."""
    hash_col = F.col(format_hash) if isinstance(format_hash, str) else as_col(format_hash)
    body = F.substring(F.col("blob"), (F.col("start") + 1).cast("int"), F.col("size").cast("int"))
    return df.withColumn("data", F.concat(header(magic, hash_col), body)).drop("blob")


def packed_slices(blobs: DataFrame, index: DataFrame, magic, format_hash, key: str = "f") -> DataFrame:
    """Bytes of winning packed entries as ``(sno, data)``.

    Entries are cut where the scan put their file; a Bloom filter of the winners drops nearly all others there, and a join on
    a unique key the rest: neither whole blobs nor losing entries are shuffled.
    """
    winners = index.select("sno", key, "i")
    place = F.xxhash64("sno", key, "i")
    entries = packed_entries(blobs, key).select("sno", key, "i", "data")
    near = entries.filter(might_contain(winners.select(place.alias("place")), place, winners.count()))
    cut = near.join(winners, ["sno", key, "i"], "left_semi")
    return cut.select("sno", F.concat(header(magic, as_col(format_hash)), "data").alias("data"))
