"""Literal lookup tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value) -> Column:
    """Column unchanged, anything else as a literal."""
    return value if isinstance(value, Column) else F.lit(value)


def lookup(key: Column, table: dict, default=None) -> Column:
    """Value of ``key`` in a small literal table.

    A map literal holds the key expression once, where a CASE would repeat it
    in every branch.
    """
    found = F.create_map(*[F.lit(part) for pair in table.items() for part in pair])[key]
    return found if default is None else F.coalesce(found, F.lit(default))
