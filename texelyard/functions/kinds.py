"""Semantic kind of a texture and of its channels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from texelyard.functions import rules
from texelyard.functions.lookups import lookup


def guess_kind(stem: Column, pixel_format: Column) -> Column:
    """First name rule that hits the lower-cased stem, else by pixel format.

    The name rules form a CASE of their own: every branch tests the stem, so
    Spark evaluates the stem once per row.
    """
    by_name = F
    for part, kind in rules.KIND_RULES:
        by_name = by_name.when(F.contains(stem, F.lit(part)), kind)
    by_format = {fmt: kind for kind, formats in rules.KIND_OF_FORMAT.items() for fmt in formats}
    return F.coalesce(by_name, lookup(pixel_format, by_format, rules.FALLBACK_KIND))


def channel_kinds(stem: Column) -> Column:
    """Kinds of the R, G, B, A channels as a four-element array."""

    def literal(kinds):
        return F.array(*[F.lit(k) for k in kinds])

    expr = F
    for part, kinds in rules.CHANNEL_KIND_RULES:
        expr = expr.when(F.contains(stem, F.lit(part)), literal(kinds))
    return expr.otherwise(literal(rules.FALLBACK_CHANNEL_KINDS))


def parse_kind(name: Column) -> Column:
    """Kind for a requested name, null when the name is not known."""
    return lookup(name, rules.KIND_OF_ARGUMENT)


def is_channel_map(kind: Column) -> Column:
    return kind.isin(rules.CHANNEL_MAP_KINDS)


def display_name(value: Column, table: str) -> Column:
    """Human-readable name from one of the tables in ``rules.DISPLAY_NAMES``."""
    return lookup(value, rules.DISPLAY_NAMES[table], "Unknown")
