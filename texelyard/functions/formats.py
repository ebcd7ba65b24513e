"""File formats, pixel formats, mip geometry and encoder options."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from texelyard import spec as job
from texelyard.functions import rules
from texelyard.functions.kinds import is_channel_map
from texelyard.functions.lookups import as_col, lookup


def classify_format(ext: Column) -> Column:
    return lookup(ext, rules.FORMAT_OF_EXT, "Unknown")


def default_ext(file_format: Column) -> Column:
    return lookup(file_format, rules.DEFAULT_OUTPUT_EXT, ".dds")


def is_bcn(pixel_format: Column) -> Column:
    return pixel_format.isin(list(rules.BYTES_PER_BLOCK))


def working_format(pixel_format: Column) -> Column:
    return lookup(pixel_format, rules.WORKING_FORMATS, rules.WORKING_FORMAT_OTHER)


def max_mips(width: Column, height: Column) -> Column:
    """Levels of a full chain: the bit length of the longer side, in integers only."""
    return F.char_length(F.bin(F.greatest(width, height)))


def effective_mips(mode, count, width: Column, height: Column) -> Column:
    """Levels to generate; 0 means the levels stay as they are."""
    full = max_mips(width, height)
    custom = F.least(F.greatest(as_col(count), F.lit(1)), full)
    mode = as_col(mode)
    return F.when(mode == job.MAXIMUM, full).when(mode == job.CUSTOM, custom).otherwise(0)


def level_size(side: Column, level) -> Column:
    """Side length at a mip level: halved and floored, never below one."""
    shifted = F.shiftright(side, level) if isinstance(level, int) else F.call_function("shiftright", side, level)
    return F.greatest(F.lit(1), shifted)


def level_bytes(pixel_format: Column, width: Column, height: Column) -> Column:
    """Bytes of one level as BIGINT."""
    w, h = width.cast("bigint"), height.cast("bigint")
    pixels = w * h * lookup(pixel_format, rules.BYTES_PER_PIXEL)
    blocks = F.shiftright(w + 3, 2) * F.shiftright(h + 3, 2) * lookup(pixel_format, rules.BYTES_PER_BLOCK)
    return F.when(is_bcn(pixel_format), blocks).otherwise(pixels)


def can_downscale(width: Column, height: Column, levels: int) -> Column:
    return (F.shiftright(width, levels) >= 1) & (F.shiftright(height, levels) >= 1)


def upscaled_mips(mips: Column, scale: int) -> Column:
    return F.when(mips > 1, mips + int(math.log2(scale))).otherwise(1)


def clamp_blp(version, encoding) -> Column:
    version, encoding = as_col(version), as_col(encoding)
    first_v1, first_v2 = rules.BLP_ALLOWED_V1[0], rules.BLP_ALLOWED_V2[0]
    return F.when(version == 0, F.when(encoding.isin(rules.BLP_ALLOWED_V1), encoding).otherwise(first_v1)).otherwise(
        F.when(encoding.isin(rules.BLP_ALLOWED_V2), encoding).otherwise(first_v2)
    )


def clamp_dds(kind: Column, dds_format) -> Column:
    fmt = as_col(dds_format)

    def within(allowed):
        return F.when(fmt.isin(allowed), fmt).otherwise(allowed[0])

    return (
        F.when(kind == "Normal", within(rules.DDS_ALLOWED_NORMAL))
        .when(is_channel_map(kind), within(rules.DDS_ALLOWED_CHANNEL))
        .otherwise(within(rules.DDS_ALLOWED_OTHER))
    )


def blp_encoding_code(encoding: Column) -> Column:
    return lookup(encoding, rules.BLP_ENCODING_CODES, "DXT")


def blp_version_name(version: Column, encoding: Column) -> Column:
    """Container version; two encodings exist in the first version only."""
    forced = blp_encoding_code(encoding).isin("JPEG", "Palettized")
    return F.when(forced | (version == 0), "BLP1").otherwise("BLP2")


def blp_target(encoding: Column) -> Column:
    return lookup(encoding, rules.BLP_TARGETS)


def dds_target(dds_format: Column) -> Column:
    return lookup(dds_format, rules.DDS_TARGETS)
