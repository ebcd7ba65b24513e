"""Arithmetic on 0..255 channel values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_u8(value: Column) -> Column:
    """Float 0..1 to 0..255, rounded half up and clamped."""
    return F.floor(F.least(F.greatest(value * 255 + 0.5, F.lit(0.0)), F.lit(255.0))).cast("int")


def int_div(a: Column, b) -> Column:
    """Integer quotient of non-negative BIGINT values."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def grey(r: Column, g: Column, b: Column) -> Column:
    """Integer mean of three channels, ties up."""
    return int_div(r + g + b + 1, 3).cast("int")


def rounded_mean(total: Column, count: Column) -> Column:
    """Mean of an exact integer sum, rounded half up once."""
    return int_div(total * 2 + count, count * 2).cast("int")


def to_signed(value: Column) -> Column:
    """0..255 to -1..1."""
    return value / 255 * 2 - 1
