"""Little-endian bytes in BINARY columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from texelyard.functions import rules
from texelyard.functions.lookups import as_col


def le_u32(blob: Column, offset: int = 0) -> Column:
    """Unsigned 32-bit value at a byte offset, as BIGINT."""
    swapped = F.concat(*[F.hex(F.substring(blob, offset + k, 1)) for k in (4, 3, 2, 1)])
    return F.conv(swapped, 16, 10).cast("bigint")


def le_hex(value) -> Column:
    """Four little-endian bytes of an integer as a hex string."""
    word = F.lpad(F.hex(as_col(value).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
    return F.concat(*[F.substring(word, at, 2) for at in (7, 5, 3, 1)])


def header(magic, format_hash) -> Column:
    """The 16-byte entry header: magic, format hash, two zero words."""
    return F.unhex(F.concat(le_hex(magic), le_hex(format_hash), F.lit("00" * 8)))


def strip_header(blob: Column, magic) -> Column:
    """Drop the 16-byte header when the blob is longer and starts with ``magic``."""
    has_header = (F.length(blob) > rules.HEADER_BYTES) & (F.hex(F.substring(blob, 1, 4)) == le_hex(magic))
    body = F.substring(blob, F.lit(rules.HEADER_BYTES + 1), F.length(blob))
    return F.when(has_header, body).otherwise(blob)
